"""Defective prompt and response pairs.

Copies are found by compressing the response with its prompt as a raw zstandard
dictionary: a response that only repeats the prompt costs a few bytes. Refusals
and languages come from dictionaries, broken-off answers from the context in
which the text ends. Each case is judged by itself; no shuffle.

Null answers are empty. A case has one defect, the first that holds of empty,
copied_question, refusal, other_language, truncated. A null prompt cannot be
copied and has no language. An unknown expected behaviour counts as ``answer``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "case_id string, defect string"
_OUT = pa.schema([("case_id", pa.string()), ("defect", pa.string())])

_OPEN, _CLOSE = "[\\[【［(（]", "[\\]】］)）]"
CITATION = re.compile(rf"{_OPEN}\s*[\w.\-]+\s*(?:::|：：)\s*\w+\s*{_CLOSE}", re.I)
#: a citation that the end of the text cuts off
OPEN_CITATION = re.compile(rf"{_OPEN}\s*[\w.\-]*(?:[:：]{{0,2}}\w*)$", re.I)
LABEL = re.compile(r"^[\s>*_#`-]*(?:answer|response|question|reply|a|q|antwort|frage|réponse|question|respuesta|pregunta)[\s*_`]*[:：][\s*_`]*", re.I)

# How an answer is declined, by language: what cannot be done or is not known, and what the sources lack.
_SOURCE = r"(?:contexts?|excerpts?|documents?|passages?|sources?|(?:provided|supplied|given|available)\s(?:text|filing|information|material)s?)"
_DECLINING = {
    "en": (
        r"(?:i|we)\s(?:cannot|can't|can\snot|could\snot|couldn't|am\snot\sable|are\snot\sable|am\sunable|are\sunable|won't|will\snot|must\sdecline|have\sto\sdecline|do\snot\s(?:have|know)|don't\s(?:have|know)|am\snot\sallowed|have\sno\s(?:idea|information|answer|data))",
        r"i'?d\srather\snot", r"i\swould\srather\snot", r"i'm\s(?:not\s(?:able|sure|allowed)|unable|afraid)",
        r"(?:cannot|can't|could\snot|couldn't|unable\sto)\s(?:be\s)?(?:answer(?:ed)?|determined?|sa(?:y|id)|tell|told|find|found|provide|help|assist|establish(?:ed)?|identif(?:y|ied))",
        r"not\spossible\s(?:for\sme\s)?to", r"no\sanswer\s(?:can\sbe\sgiven|is\savailable|available)", r"(?:not\senough|insufficient|no\srelevant)\sinformation", r"against\smy\sguidelines", r"decline\sto\s(?:answer|comment)",
        _SOURCE + r"\s(?:(?:provided|supplied|given)\s)?(?:(?:does|do)(?:\snot|n't)\s(?:contain|include|mention|provide|say|state|specify|answer|address)|lacks?\b|omits?\b|(?:is|are)\ssilent|(?:contains?|includes?|provides?|gives?|has|have|says?)\s(?:no\b|nothing))",
    ),
    "de": (r"(?:kann|können|darf|dürfen)\s(?:ich|wir)?\s?(?:\w+\s){0,4}(?:nicht|keine)", r"enthalten\s(?:\w+\s){0,3}kein\w*", r"nicht\s(?:möglich|beantworten)", r"keine\s(?:ahnung|antwort|informationen|angaben)\b", r"weiß\s(?:ich\s)?(?:es\s|das\s)?(?:leider\s)?nicht"),
    "fr": (r"ne\s(?:peux|pouvons|puis|sais|savons|dispose|disposons)\s?pas", r"n'(?:ai|avons)\s(?:pas|aucune)", r"impossible\sde", r"ne\scontien(?:t|nent)\spas", r"(?:pas|aucune)\s(?:de\s)?réponse"),
    "es": (r"no\s(?:puedo|podemos|sé|sabemos|tengo|tenemos|dispongo|disponemos)", r"no\s(?:me\s)?es\sposible", r"no\scontienen?", r"no\shay\s(?:respuesta|información|datos)"),
    "it": (r"non\s(?:posso|possiamo|so|sappiamo|ho|abbiamo)\b", r"non\sè\spossibile", r"non\sconten(?:gono|ga)", r"nessuna\s(?:risposta|informazione)"),
    "pt": (r"não\s(?:posso|podemos|sei|sabemos|tenho|temos|consigo)", r"não\sé\spossível", r"não\scont[ée]m", r"não\shá\s(?:resposta|informaç\w+|dados)"),
    "nl": (r"kan\s(?:ik|het)\sniet", r"ik\skan\s(?:\w+\s){0,3}niet", r"weet\sik\s(?:het\s)?niet", r"geen\s(?:antwoord|informatie|idee)"),
    "sv": (r"kan\s(?:jag\s)?(?:tyvärr\s)?inte", r"vet\s(?:jag\s)?inte", r"(?:inget\ssvar|ingen\sinformation)"),
    "da": (r"kan\s(?:jeg\s)?(?:desværre\s)?ikke", r"ved\s(?:jeg\s)?(?:det\s)?ikke", r"(?:intet\ssvar|ingen\soplysninger|ingen\sinformasjon)"),
    "fi": (r"en\s(?:voi|tiedä|pysty|osaa)", r"ei\s(?:vastausta|tietoa)"),
    "pl": (r"nie\s(?:mogę|możemy|wiem|wiemy|mam|potrafię)", r"brak\s(?:informacji|odpowiedzi|danych)"),
    "cs": (r"(?:nemohu|nemůžu|nevím|nemám)", r"není\s(?:možné|odpověď)"),
}
_REFUSALS = re.compile(r"\b(?:" + "|".join(p for phrases in _DECLINING.values() for p in phrases) + r")(?!\w)", re.I)
#: a figure that answers: an amount or a share, not a year
FIGURE = re.compile(r"[$€£¥]\s?\**\d|\d[\d.,]*\s?\**\s?(?:%|percent|per\scent|thousand|[mb]illion|prozent|millionen|milliarden|tausend|millions|milliards|mille|millones|mil\b|milh|milion|miliard)", re.I)

# Common words by language.
_WORDS = {
    "en": "the of was and for with what which did how that came by says about its state reported any change from this at as on had been is are to not compared summarize answer year higher than prior filing only using factors explain in reached did",
    "de": "der die das und im von nicht betrug für lag bei ist eine einem einer wie hoch war was berichtet über den dem des hat sich zu mit als nach auf wird wurde jahr geschäftsjahr insgesamt gegenüber keine ich dazu kann um vom ohne dass welche",
    "fr": "le la les des du et était est pour dans une ne pas quel que dit sur comment a t il été par au aux en son montant solde rapport exercice avec qui cette je contre plus tôt un de élevé cours malgré",
    "es": "el los las del y fue para que con ejercicio por frente se cuál cómo qué informa sobre cambió una en su al año antes no la lo de un es debido durante situó alcanzó",
    "it": "il lo gli di e nel nella è stato pari rispetto al per della dell dei ha raggiunto precedente che con non una un anno esercizio",
    "pt": "o os da do das dos e no na foi em para com não uma um ao chegou contra anterior exercício receita ano de que é",
    "nl": "het een van bedroeg niet voor met wat hoe werd zijn is aan naar jaar boekjaar de en in",
    "sv": "och att det som är av till på med inte den ett har jag från hos år räkenskapsåret var uppgick intäkter miljoner under",
    "da": "og at det som er af til på med ikke den et har jeg fra hos år regnskabsåret var beløb sig omsætningen millioner ved",
    "fi": "ja oli on ei että vuonna tilikaudella yhtiön liikevaihto miljoonaa euroa dollaria mukaan sekä oli nousi laski verrattuna",
    "pl": "jest był była było nie że się w na z oraz roku przychody wyniosły wyniosła milionów dolarów spółki zysk przez wzrosły",
    "cs": "je byl byla bylo že se v na s roce výnosy činily milionů dolarů společnosti čistý zisk oproti podle",
    "hu": "és az volt nem hogy évben bevétele millió dollár szerint vállalat nyereség mint",
    "ro": "și de la în cu nu fost pentru anul venituri milioane dolari conform societății",
    "tr": "ve bir bu için ile yılında olarak gelir milyon dolar şirketin kâr göre oldu",
}
LANGUAGES = {k: frozenset(v.split()) for k, v in _WORDS.items()}
#: the languages of a word; a word of several speaks less for each
_LANGUAGES_OF = {w: [k for k, v in LANGUAGES.items() if w in v] for v in LANGUAGES.values() for w in v}
_WORD = re.compile(r"[^\W\d_]+")

_TERMINAL = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
_AMOUNT = r"\**[$€£¥]?\s?\d[\d.,]*\s?(?:%|percent|thousand|[mb]illion|prozent|million\w*|milliard\w*|millones|milh\w+|mili\w+|mil)?(?:\s(?:\w+\s)?(?:dollars?|dollar|dólares|dollari|euros?))?\**"
#: a list entry or a bare figure that is whole without a full stop
_ENTRY = re.compile(rf"^(?:[-*•]|\d+[.)])\s+[^\n:]+:\s*{_AMOUNT}$", re.I)
_ENTRY_AMOUNT = re.compile(r"(?:%|thousand|illion|rozent|illionen|illions|illones|ilh\w+|ilion\w*|iliard\w*|dollars?|ólares|euros?)\**$", re.I)
_BARE = re.compile(rf"^(?:{_AMOUNT}|(?:about|around|roughly|some|etwa|rund|environ|cerca|alrededor)\b.*\d\**|yes|no|ja|nein|oui|non|sí|si|none)$", re.I)
_CUT_NUMBER = re.compile(r"(?:[$€£¥]\s?\d[\d,]*|\b(?:by|with|of|or|from|than|to|um|von|de|un|contre|nach|frente\sa)\s\d{1,2})\.$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')*\]]*\s+")
_NOT_AN_END = re.compile(r"\b(Inc|Corp|Co|Ltd|N\.V|U\.S|No|St)\.")


def _plain(text: str | None) -> str:
    """Compatibility forms and invisible characters made plain; curly apostrophes straight."""
    text = unicodedata.normalize("NFKC", text or "")
    return "".join(c for c in text if unicodedata.category(c) != "Cf").replace("’", "'")


def _said(text: str) -> str:
    """A text without citations and leading labels."""
    text = CITATION.sub(" ", text)
    while (cut := LABEL.sub("", text)) != text:
        text = cut
    return text.strip()


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def novelty(prompt: str, response: str) -> float:
    """Bytes that a response costs beyond an empty frame, given the prompt as dictionary, by its length."""
    data = response.encode()
    if not data or len(prompt) < 8:
        return 1.0
    dictionary = zstandard.ZstdCompressionDict(prompt.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
    return max(0, len(coder.compress(data)) - 9) / len(data)


def copies(prompt: str, response: str, most: float = 0.4) -> bool:
    """Whether a response only repeats its prompt: cheap given the prompt, most of the prompt's words in their order, next to nothing of its own.

    A prompt under 8 bytes is too short for a dictionary: it is only copied by the same words.
    """
    p, r = " ".join(_words(_said(prompt))), " ".join(_words(response))
    if p and p == r:
        return True
    if not p or not r or novelty(p, r) > most:
        return False
    known, words = set(p.split()) | set(_words(prompt)), r.split()
    own = [w for w in words if w not in known]
    prompt_words = p.split()
    told = set(words)
    missing = sum(w not in told for w in prompt_words)
    return len(own) <= max(2, len(words) // 8) and not any(w.isdigit() for w in own) and missing <= max(2, len(prompt_words) // 5)


def language(text: str) -> tuple[str | None, dict[str, float]]:
    """The language with most common words, and all (weighted) counts; None where none leads."""
    score = dict.fromkeys(LANGUAGES, 0.0)
    for w in _WORD.findall(text.lower()):
        if spoken := _LANGUAGES_OF.get(w):
            for k in spoken:
                score[k] += 1 / len(spoken)
    best = sorted(score, key=score.get, reverse=True)
    return (best[0] if score[best[0]] > score[best[1]] else None), score


# Scripts by the first word of their Unicode character names.
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "DEVANAGARI", "THAI")


def script(text: str) -> str:
    """The script of most letters; LATIN where there are none."""
    if text.isascii():
        return "LATIN"
    count: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            name = "LATIN" if c < "\u0250" else unicodedata.name(c, "?").split(" ")[0]
            count[name] = count.get(name, 0) + 1
    best = max(count, key=count.get, default="LATIN")
    return best if best in _SCRIPTS else "LATIN"


def refuses(text: str) -> bool:
    return bool(_REFUSALS.search(text)) and not FIGURE.search(text)


def breaks_off(text: str) -> bool:
    """Whether a text ends within a word, sentence, list entry or citation."""
    body = text.rstrip()
    open_end = OPEN_CITATION.search(body)
    if open_end and not re.search(_CLOSE, open_end.group(0)):
        return True
    said = CITATION.sub("", body).rstrip()
    said = re.sub(r"\s+\.$", ".", said)
    if not said:
        return False
    last = said[said.rfind("\n") + 1 :].strip()
    if last.startswith("|"):
        return not last.endswith("|")
    if last.count("**") % 2:
        return True
    if _TERMINAL.search(said):
        return bool(_CUT_NUMBER.search(said))
    if re.match(r"(?:[-*•]|\d+[.)])\s", last) or re.fullmatch(r"[-*•]|\d+[.)]", last):
        return not (_ENTRY.match(last) and _ENTRY_AMOUNT.search(last))
    plain = LABEL.sub("", said)
    return not (_BARE.match(plain) and len(_SENTENCE.split(_NOT_AN_END.sub(r"\1", plain))) == 1)


def defect(prompt: str | None, response: str | None, expected: str | None) -> str | None:
    p, r = _plain(prompt), _plain(response)
    said = _said(r)
    if not re.search(r"[^\W_]", said) and not (OPEN_CITATION.search(said) and re.search(r"\w", said)):
        return "empty"
    if re.fullmatch(rf"[\s>*_#-]*{OPEN_CITATION.pattern}", said) and re.search(_OPEN, said):
        return "truncated"
    if copies(p, said):
        return "copied_question"
    if refuses(said):
        return None if expected == "abstain" else "refusal"
    if script(p) != script(said):
        return "other_language"
    asked, _ = language(p)
    given, score = language(said)
    if asked and given and asked != given and score[given] >= 2 and score[asked] * 1.25 <= score[given]:
        return "other_language"
    return "truncated" if breaks_off(r) else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, *rest = (c.to_pylist() for c in b.columns)
        found = [(i, d) for i, *x in zip(ids, *rest, strict=True) if (d := defect(*x))]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], schema=_OUT)


def defective(cases: DataFrame, key: str = "case_id", prompt: str = "question", response: str = "answer", expected: str = "expected_behavior") -> DataFrame:
    """One row per defective case with its defect type."""
    return cases.select(F.col(key).alias("case_id"), F.col(prompt), F.col(response), F.col(expected)).mapInArrow(_judge, SCHEMA)
