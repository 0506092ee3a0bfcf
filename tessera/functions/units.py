"""Grammar of unit and number expressions.

A unit is a scale, an offset and a vector of integer exponents over base
dimensions; two expressions denote the same quantity when their vectors agree.
``parse_unit`` reads an expression such as ``USD thousands``, ``cents (CAD) per
share``, ``utr:sqft`` or ``kUSD``; ``parse_number`` reads a printed number.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from decimal import Decimal

ONE = Decimal(1)


@dataclass(frozen=True)
class Unit:
    """value_in_base = value * scale + offset, in the dimensions ``dims``."""

    scale: Decimal = ONE
    dims: tuple[tuple[str, int], ...] = ()
    offset: Decimal = Decimal(0)
    #: True where the expression itself names a multiple (thousand, cents, ...).
    scaled: bool = False
    #: True where any unit word (not only a multiple) was read.
    named: bool = False
    #: True where the currency is a bare dollar sign, or cents of no currency.
    bare: bool = False

    def times(self, other: "Unit", power: int = 1) -> "Unit":
        exps = dict(self.dims)
        for d, p in other.dims:
            exps[d] = exps.get(d, 0) + p * power
        factor = other.scale if power > 0 else ONE / other.scale
        return Unit(
            self.scale * factor,
            tuple(sorted((d, p) for d, p in exps.items() if p)),
            self.offset or other.offset,
            self.scaled or other.scaled,
            self.named or other.named,
            self.bare or other.bare,
        )


CURRENCIES = ("USD", "EUR", "GBP", "CAD", "JPY")

# Unit words, their scale and base dimension.
BASE_UNITS: dict[str, tuple[str, str]] = {
    "usd": ("1", "USD"), "us$": ("1", "USD"), "u.s. dollars": ("1", "USD"), "u.s. dollar": ("1", "USD"), "us dollars": ("1", "USD"),
    "eur": ("1", "EUR"), "euro": ("1", "EUR"), "euros": ("1", "EUR"), "€": ("1", "EUR"),
    "gbp": ("1", "GBP"), "pounds sterling": ("1", "GBP"), "pound sterling": ("1", "GBP"), "£": ("1", "GBP"),
    "cad": ("1", "CAD"), "c$": ("1", "CAD"), "ca$": ("1", "CAD"), "canadian dollars": ("1", "CAD"), "canadian dollar": ("1", "CAD"),
    "jpy": ("1", "JPY"), "yen": ("1", "JPY"), "¥": ("1", "JPY"),
    "pence": ("0.01", "GBP"), "p": ("0.01", "GBP"),
    "shares": ("1", "shares"), "share": ("1", "shares"),
    "pure": ("1", ""), "percent": ("0.01", ""), "per cent": ("0.01", ""), "pct": ("0.01", ""), "%": ("0.01", ""), "percentage": ("0.01", ""),
    "bps": ("0.0001", ""), "bp": ("0.0001", ""), "basis points": ("0.0001", ""), "basis point": ("0.0001", ""),
    "sqm": ("1", "sqm"), "m2": ("1", "sqm"), "square metres": ("1", "sqm"), "square meters": ("1", "sqm"), "sq m": ("1", "sqm"),
    "sqft": ("0.09290304", "sqm"), "sf": ("0.09290304", "sqm"), "sq ft": ("0.09290304", "sqm"), "square feet": ("0.09290304", "sqm"), "square foot": ("0.09290304", "sqm"), "ft2": ("0.09290304", "sqm"),
    "acre": ("4046.8564224", "sqm"), "acres": ("4046.8564224", "sqm"), "ac": ("4046.8564224", "sqm"),
    "ha": ("10000", "sqm"), "hectare": ("10000", "sqm"), "hectares": ("10000", "sqm"),
    "t": ("1", "t"), "tonne": ("1", "t"), "tonnes": ("1", "t"), "metric tons": ("1", "t"), "metric ton": ("1", "t"), "metric tonnes": ("1", "t"),
    "kt": ("1000", "t"), "mt": ("1000000", "t"), "kg": ("0.001", "t"), "kilogram": ("0.001", "t"), "kilograms": ("0.001", "t"),
    "short tons": ("0.90718474", "t"), "short ton": ("0.90718474", "t"), "long tons": ("1.0160469088", "t"),
    "lb": ("0.00045359237", "t"), "lbs": ("0.00045359237", "t"), "pound": ("0.00045359237", "t"), "pounds": ("0.00045359237", "t"),
    "mwh": ("1", "MWh"), "megawatt hours": ("1", "MWh"), "megawatt hour": ("1", "MWh"),
    "kwh": ("0.001", "MWh"), "kilowatt hours": ("0.001", "MWh"), "kilowatt hour": ("0.001", "MWh"),
    "gwh": ("1000", "MWh"), "gigawatt hours": ("1000", "MWh"), "gigawatt hour": ("1000", "MWh"),
    "twh": ("1000000", "MWh"), "terawatt hours": ("1000000", "MWh"),
    "bbl": ("1", "bbl"), "bbls": ("1", "bbl"), "barrel": ("1", "bbl"), "barrels": ("1", "bbl"), "mbbl": ("1000", "bbl"), "mmbbl": ("1000000", "bbl"),
    "k": ("1", ""), "degc": ("1", "K"), "degf": ("0.5555555555555556", "K"),
}
OFFSETS = {"degc": Decimal("273.15"), "degf": Decimal("255.3722222222222")}
#: Multiples; the case-sensitive ones come first.
MULTIPLES: dict[str, str] = {
    "thousand": "1e3", "thousands": "1e3", "th": "1e3", "k": "1e3", "000": "1e3", "000s": "1e3", "tsd": "1e3",
    "million": "1e6", "millions": "1e6", "mn": "1e6", "mm": "1e6", "m": "1e6", "mio": "1e6", "million's": "1e6",
    "billion": "1e9", "billions": "1e9", "bn": "1e9", "b": "1e9", "mrd": "1e9",
}
GERMAN = re.compile(r"\b(tsd|mio|mrd)\b", re.I)
IGNORED = frozenset("of in the amounts amount and us".split())
#: A unit word that is also a plain multiple is the multiple, but for those named here.
_TWO_WORD = frozenset(k for k in BASE_UNITS if " " in k)
_GLUED = re.compile(r"^(usd|eur|gbp|cad|jpy|shares?|sqft|bbl|mwh)(th|k|m|mm|mn|bn|b)$|^(k|m|mm|bn)(usd|eur|gbp|cad|jpy|shares)$")
_TOKEN = re.compile(r"c\$|ca\$|us\$|u\.s\. dollars?|[^\W\d_]+\d?|'?0{3}s?(?!\d)|[€£¥$¢%/]", re.I)
_CASED = {"GBp": Unit(Decimal("0.01"), (("GBP", 1),), scaled=True, named=True), "GBX": Unit(Decimal("0.01"), (("GBP", 1),), scaled=True, named=True)}


def clean(text: str) -> str:
    """Width, compatibility characters, invisible characters and dashes made plain."""
    if text.isascii():
        return text.strip()
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return re.sub(r"[‐‑‒–—−]", "-", text).replace("’", "'").strip()


def _unit(word: str) -> Unit | None:
    if word in ("cents", "cent", "¢", "c"):
        return Unit(Decimal("0.01"), (), scaled=True, named=True, bare=True)
    if word in ("$", "dollars", "dollar"):
        return Unit(ONE, (), named=True, bare=True)
    hit = BASE_UNITS.get(word)
    if hit is None or word == "k":
        return None
    scale = Decimal(hit[0])
    return Unit(scale, ((hit[1], 1),) if hit[1] else (), OFFSETS.get(word, Decimal(0)), scale != 1, True)


def parse_unit(expression: str | None) -> tuple[Unit, list[str]]:
    """The unit of an expression and the words that were not understood.

    term (('/' | 'per') term)*; a term multiplies units and multiples. A multiple
    counts once, however often it is named.
    """
    raw = clean(expression or "")
    raw = re.sub(r"\b(iso4217|xbrli|utr)\s*:", "", raw, flags=re.I)
    if raw in _CASED:
        return _CASED[raw], []
    words = [m.group(0) for m in _TOKEN.finditer(raw.replace("_", " ").replace("-", " "))]
    out, unknown, power, multiple, i = Unit(), [], 1, None, 0
    while i < len(words):
        cased, word = words[i], words[i].lower()
        two = word + " " + words[i + 1].lower() if i + 1 < len(words) else ""
        i += 1
        if two in _TWO_WORD:
            out, i = out.times(_unit(two), power), i + 1
        elif cased in _CASED:
            out = out.times(_CASED[cased], power)
        elif word in ("/", "per"):
            power = -1
        elif word == "m" and i < len(words) and words[i] == "/":
            unknown.append(word)  # metres per something, no million
        elif word.strip("'") in MULTIPLES and not (word == "m" and power < 0):
            multiple = Decimal(MULTIPLES[word.strip("'")])
        elif (unit := _unit(word)) is not None:
            out = out.times(unit, power)
        elif glued := _GLUED.match(word):
            base, suffix = (glued[1], glued[2]) if glued[1] else (glued[4], glued[3])
            out, multiple = out.times(_unit(base), power), Decimal(MULTIPLES[suffix])
        elif word not in IGNORED:
            unknown.append(word)
    if multiple is not None:
        out = out.times(Unit(multiple, scaled=True))
    return out, unknown


_SCALE = r"(thousands?|millions?|billions?|'?000s?|mm|mn|bn)"
_MONEY = r"(usd|eur|gbp|cad|jpy|u\.s\. dollars|canadian dollars|pounds sterling|euros|yen)"
#: What a note must say for its multiple to be one of the record: a plural multiple, or one beside a currency code.
_NOTE_PLURAL = re.compile(r"(?<![\d.] )(?<!\w)(thousands|millions|billions)(?!\w)", re.I)
_NOTE_CODE = re.compile(_MONEY + r"\s*" + _SCALE + r"(?!\w)", re.I)
_NOTE_UNIT = re.compile(
    _MONEY + r"|square feet|square metres|acres|hectares|short tons|tonnes|kilograms|pounds|barrels|(?:giga|mega|kilo)watt hours|[mgkt]wh\b|\bshares?\b|\bshare counts\b", re.I
)
_NOTE_PART = re.compile(r"\b(cents|pence) per share\b|\bin (?:(usd|eur|gbp|cad|jpy) )?(cents|pence)\b", re.I)
_NOTE_RATIO = re.compile(r"\b(?:in|as an?|expressed as an?) (basis points|percentage|percent|per cent)\b", re.I)


def parse_note(note: str | None) -> tuple[Decimal | None, str | None, Unit | None]:
    """(multiple, currency or unit word, part unit such as cents or a ratio) that a note declares.

    Prose with figures of its own ("$4.1 million of expense", "the nearest
    thousand", "two thousand employees") declares nothing.
    """
    text = clean(note or "")
    if not text:
        return None, None, None
    multiple = None
    if hit := _NOTE_PLURAL.search(text):
        multiple = Decimal(MULTIPLES[hit[1].lower()])
    elif hit := _NOTE_CODE.search(text):
        multiple = Decimal(MULTIPLES[hit[2].lower().strip("'")])
    part = None
    if hit := _NOTE_PART.search(text):
        part = parse_unit((hit[2] or "") + " " + (hit[1] or hit[3]).lower())[0]
    elif hit := _NOTE_RATIO.search(text):
        part = parse_unit(hit[1])[0]
    unit = _NOTE_UNIT.search(text)
    return multiple, unit[0].lower() if unit else None, part


_SMALL = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
_DIGITS = re.compile(r"\d(?:[\d.,']|(?: (?=\d{3}(?!\d))))*")


def number_words(words: list[str]) -> int | None:
    """English words below a thousand ("twenty five", "three hundred") as a number."""
    total, seen = 0, False
    for w in words:
        if w in _SMALL:
            total += _SMALL[w]
        elif w in _TENS:
            total += _TENS[w]
        elif w == "hundred" and seen:
            total *= 100
        else:
            return None
        seen = True
    return total if seen else None


def read_figures(figures: str, *, european: bool, dotted_groups: bool) -> Decimal | None:
    """A printed figure as a number.

    With both separators the later one is the decimal one; a repeated one
    groups. One comma before three digits groups (in European style it is the
    decimal comma only before another number of digits), one point before three
    digits groups in European style or where ``dotted_groups`` says so.
    """
    s = figures.replace(" ", "").replace("'", "").rstrip(".,")
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        s = s.replace(",", "") if s.rfind(".") > s.rfind(",") else s.replace(".", "").replace(",", ".")
    elif commas:
        groups = all(len(g) == 3 for g in s.split(",")[1:]) and not s.startswith("0")
        s = s.replace(",", "") if commas > 1 or groups else s.replace(",", ".")
    elif dots > 1:
        s = s.replace(".", "")
    elif dots and len(s.split(".")[1]) == 3 and not s.startswith("0") and len(s.split(".")[0]) <= 3 and (european or dotted_groups):
        s = s.replace(".", "")
    try:
        return Decimal(s)
    except ArithmeticError:
        return None


def split_display(display: str | None) -> tuple[str | None, str, bool]:
    """(figures or number words, unit expression, negative) of a printed value; figures None where it holds no number."""
    text = clean(display or "")
    hit = _DIGITS.search(text)
    if hit:
        before, after = text[: hit.start()], text[hit.end() :]
        negative = before.rstrip().endswith("-") or before.lstrip().startswith("-") or (before.rstrip().endswith("(") and ")" in after)
        if re.search(r"\b(note|page|item|see)\b", before, re.I):
            return None, "", False
        return hit.group(0), re.sub(r"[()\-]", " ", before) + " " + re.sub(r"[()]", " ", after), negative
    words = re.findall(r"[a-z]+", text.lower())
    for n in range(len(words), 0, -1):
        if number_words(words[:n]) is not None:
            return " ".join(words[:n]), " ".join(words[n:]), "(" in text
    return None, "", False
