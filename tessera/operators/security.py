"""Poisoned text among retrieved candidates: normalisation, signs, provenance, duplicates, rates.

A text is normalised first (compatibility forms, invisible and control characters,
white space); signs are patterns of a verb, its qualifiers and its object, built
here from sets of words. Only texts outside ASCII go to Python, in Arrow batches.
"""

from __future__ import annotations

import unicodedata
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tessera.operators import phrases as P
from tessera.operators.guards import mentions

_OVERRIDING = ("ignore", "disregard", "override", "forget", "bypass", "do not follow", "do not obey", "stop following")
_EARLIER = ("all", "any", "the", "your", "previous", "prior", "above", "earlier", "system", "developer", "grounding", "of", "these", "those")
_RULES = ("instructions?", "rules?", "messages?", "prompts?", "directives?", "guidelines?")
_ROLES = ("system", "developer", "assistant")
_MODES = ("developer", "system", "admin", "unrestricted", "god")
_SELVES = ("chatgpt", "an ai assistant", "the assistant", "an unrestricted model")
_SHOWING = ("reveal", "print", "show", "display", "dump", "return", "leak", "output", "repeat")
_SECRETS = ("system prompt", "developer message", "hidden prompt")
_TOOLS = ("tool", "browser", "web", "python", "shell", "api")
_PROGRAMS = ("command", "shell", "powershell", "python", "script", "code")
_SENDING = ("context", "prompt", "data", "answer", "conversation")


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


# Each sign: its weight and pattern; those marked with a true are poison by themselves.
SIGNS: dict[str, tuple[float, str, bool]] = {
    "instruction_override": (0.55, rf"(?i)\b{_any(_OVERRIDING)}(?: {_any(_EARLIER)}){{1,4}} {_any(_RULES)}\b", True),
    "role_impersonation": (0.50, rf"(?i)\byou are (?:now )?(?:(?:in )?{_any(_MODES)} mode|{_any(_SELVES)})\b|\bnew instructions from (?:the )?{_any(('developer', 'system'))}\b", True),
    "prompt_exfiltration": (0.50, rf"(?i)\b{_any(_SHOWING)}\b.{{0,80}}\b{_any((*_SECRETS, 'instructions'))}\b|\b{_any(_SECRETS)}\b.{{0,80}}\b{_any(_SHOWING)}\b", True),
    "tool_instruction": (0.45, rf"(?i)\b{_any(('call', 'invoke', 'use'))} (?:the )?{_any(_TOOLS)}\b|\b{_any(('execute', 'run'))} {_any(('this', 'the following', 'a'))} {_any(_PROGRAMS)}\b|\bsend {_any(('the', 'this', 'all'))} {_any(_SENDING)} to\b", True),
    "boundary_escape": (0.45, rf"(?i)<<<{_any(('begin', 'end'))}_retrieved_evidence", True),
}
#: role labels at the beginning of a line, asked of the text before its lines are joined
_LABEL = rf"(?im)^[ \t]*{_any(_ROLES)}(?:[ \t]+(?:message|prompt|instruction))?[ \t]*:"
#: an override or a request for the prompt, without blanks: what remains when letters are set apart
_COMPACT = _any([*("".join(x) for x in product(("ignore", "disregard", "forget", "override"), ("", "all"), ("previous", "prior", "system"), ("instructions",))), *("".join(x) for x in product(("reveal", "show", "print"), ("your", "the"), ("systemprompt",))), "developerinstructions"])
HIDDEN = r"(?is)<!--.*?-->|<\s*(?:script|style|template)\b.*?</\s*(?:script|style|template)\s*>|display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\s*="
WEIGHTS = {**{n: w for n, (w, _, _) in SIGNS.items()}, "obfuscated_instruction": 0.35, "hidden_markup": 0.25, "zero_width": 0.25, "control_character": 0.20}
BLOCKED_FROM = 0.75
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Compatibility forms made plain (NFKC); ASCII texts stay in the JVM."""
    wide = text.rlike("[^\\x00-\\x7F]")
    return F.coalesce(_compatible(F.when(wide, text)), text)


def visible(text: Column) -> Column:
    """Without invisible characters, control characters as blanks."""
    return F.regexp_replace(F.regexp_replace(text, f"[{P.ZERO_WIDTH}]", ""), _CONTROL, " ")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def scanned(df: DataFrame, text: str) -> DataFrame:
    """Rows with flags, risk (at most 1), status (blocked, suspicious or approved) and fingerprint of the normalised text. Null text has no flags.

    A text that discusses attacks and only words an override is approved with a risk of 0.1.
    """
    plain = df.withColumn("__n", compatible(F.coalesce(text, F.lit(""))))
    plain = plain.withColumns({"__v": visible(F.col("__n"))})
    plain = plain.withColumns({"__t": collapsed(F.col("__v"))})
    t = F.col("__t")
    low = F.lower(t)
    squeezed = F.regexp_replace(low, "[^a-z0-9]", "")
    flag = {n: t.rlike(p) for n, (_, p, _) in SIGNS.items()}
    flag["role_impersonation"] = flag["role_impersonation"] | F.col("__v").rlike(_LABEL)
    flag["obfuscated_instruction"] = squeezed.rlike(_COMPACT) & ~flag["instruction_override"] & ~flag["prompt_exfiltration"]
    flag |= {"hidden_markup": F.col("__v").rlike(HIDDEN), "zero_width": F.col("__n").rlike(f"[{P.ZERO_WIDTH}]"), "control_character": F.col("__n").rlike(_CONTROL)}
    flags = F.array_compact(F.array(*(F.when(flag[n], F.lit(n)) for n in WEIGHTS)))
    out = plain.withColumn("flags", flags)
    has = lambda n: F.array_contains("flags", n)
    total = F.lit(0.0)
    for n, w in WEIGHTS.items():
        total = total + F.when(has(n), w).otherwise(0.0)
    risk = F.least(F.lit(1.0), F.round(total, 2))
    words_only = mentions(low, P.DISCUSSION) & mentions(low, P.DISCUSSING) & (F.size(F.array_except("flags", F.array(F.lit("instruction_override")))) == 0)
    poison = F.arrays_overlap("flags", F.array(*(F.lit(n) for n, (_, _, p) in SIGNS.items() if p)))
    # A sign that is no poison by itself blocks where the risks add up.
    heavy = has("obfuscated_instruction") & (risk >= BLOCKED_FROM)
    status = F.when(words_only, "approved").when(poison | heavy, "blocked").when(F.size("flags") > 0, "suspicious").otherwise("approved")
    return out.withColumns({"risk": F.when(words_only, 0.1).otherwise(risk), "status": status, "fingerprint": F.sha2("__t", 256)}).drop("__n", "__v", "__t")


def filtered(candidates: DataFrame, query: str, order: str, sources: list[str]) -> DataFrame:
    """Every candidate (query, order, chunk_id, document_id, text, source) with its status, flags, risk and duplicate_of.

    One without its provenance, or from a source that is not allowed, is blocked
    unread and hides no later copy of its text; of texts with the same fingerprint
    the first in order stands, the others are blocked and name it. Equal places are
    settled by chunk_id.
    """
    blank = lambda c: ~F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    lacks = blank(P.PROVENANCE[0])
    for c in P.PROVENANCE[1:]:
        lacks = lacks | blank(c)
    known = scanned(candidates.withColumns({"__lacks": lacks, "__other": ~F.coalesce(F.col("source").isin(sources), F.lit(False))}), "text")
    sound = ~F.col("__lacks") & ~F.col("__other")
    place = F.struct(order, "chunk_id")
    first = known.where(sound).groupBy(query, "fingerprint").agg(F.min(place).alias("first"))
    j = known.join(first, [query, "fingerprint"], "left")
    repeated = sound & (place != F.col("first"))
    only = lambda n: F.array(F.lit(n))
    return j.select(
        query, order, "chunk_id",
        F.when(~sound | repeated, "blocked").otherwise(F.col("status")).alias("status"),
        F.when(F.col("__lacks"), only("missing_provenance")).when(F.col("__other"), only("invalid_source")).when(repeated, F.array_union("flags", only("duplicate_content"))).otherwise(F.col("flags")).alias("flags"),
        F.when(~sound, 1.0).otherwise(F.col("risk")).alias("risk"),
        F.when(repeated, F.col("first.chunk_id")).alias("duplicate_of"),
    )


def streams(kept: DataFrame, query: str, order: str) -> DataFrame:
    """(query, stream, place, chunk_id): approved, suspicious and blocked candidates, each numbered in order."""
    w = Window.partitionBy(query, "status").orderBy(order, "chunk_id")
    return kept.select(query, F.col("status").alias("stream"), F.row_number().over(w).alias("place"), "chunk_id")


def summary(kept: DataFrame, query: str) -> DataFrame:
    """Counts of each query's candidates by outcome, and whether all of its context is blocked."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    flagged = lambda *n: F.count_if(F.arrays_overlap("flags", F.array(*map(F.lit, n))))
    return kept.groupBy(query).agg(
        F.count("*").alias("candidates"), is_("approved").alias("approved"), is_("suspicious").alias("suspicious"), is_("blocked").alias("blocked"),
        flagged("duplicate_content").alias("duplicates"), flagged("missing_provenance").alias("missing_provenance"), flagged("invalid_source").alias("invalid_source"),
        flagged(*SIGNS, "obfuscated_instruction").alias("poisoned"), flagged("hidden_markup", "zero_width", "control_character", "obfuscated_instruction").alias("obfuscated"),
        (is_("approved") == 0).alias("all_blocked"),
    )


def fixture_rates(cases: DataFrame) -> DataFrame:
    """Rates over cases (category, expected, status); a rate over no case is 1 where it should be high and 0 where it should be low."""
    clean, poison = F.col("expected") == "approved", F.col("expected") != "approved"
    let = F.col("status") == "approved"

    def rate(of: Column, hit: Column, empty: float, name: str) -> Column:
        return F.round(F.coalesce(F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0)), F.lit(empty)), 9).alias(name)

    stopped = F.col("status") == "blocked"
    return cases.agg(
        rate(poison, ~let, 1.0, "poison_detection_recall"), rate(clean, ~let, 0.0, "false_positive_rate"), rate(poison, let, 0.0, "malicious_context_acceptance_rate"), rate(poison, let, 0.0, "poison_retrieval_acceptance_rate"),
        rate(clean, let, 1.0, "clean_candidate_retention_rate"), rate(F.col("expected") == "blocked", stopped, 1.0, "high_confidence_poison_blocked_rate"), rate(F.col("category") == "metadata_provenance_failures", stopped, 1.0, "missing_provenance_blocked_rate"),
        F.count("*").alias("cases"), F.count_if(poison).alias("poison_cases"), F.count_if(clean).alias("clean_cases"),
    )
