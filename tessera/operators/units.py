"""Quantities in different units, brought to the common unit of their concept.

A unit is read by a grammar into scale, offset and exponents; its exponents are
compared with those of the concept, and where they differ there is no value but the
outcome ``dimension_mismatch``. Each distinct (concept, unit, note) of a batch is
parsed once; numbers are computed as decimals only for the rows that change. No
shuffle, no driver work. Nulls and unreadable texts give no row; a result outside
64 bits is null. A concept that is not in the table has the kind of its unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import units as U

SCHEMA = "source_table string, record_key string, common_unit string, value_e4 bigint"
_OUT = pa.schema([("source_table", pa.string()), ("record_key", pa.string()), ("common_unit", pa.string()), ("value_e4", pa.int64())])

# The kind of quantity of each concept, by its whole name or its beginning, end or part (marked by ...); the first that fits.
CONCEPTS = (
    ("Assets", "money"), ("Liabilities", "money"), ("StockholdersEquity", "money"), ("CashAndCashEquivalentsAtCarryingValue", "money"), ("LongTermDebt", "money"), ("Revenues", "money"),
    ("NetIncomeLoss", "money"), ("OperatingIncomeLoss", "money"), ("ResearchAndDevelopmentExpense", "money"), ("InterestPaidNet", "money"),
    ("EarningsPerShare...", "per_share"), ("...DividendsPerShare...", "per_share"),
    ("...NumberOfSharesOutstanding...", "shares"), ("...SharesOutstanding", "shares"),
    ("EffectiveIncomeTaxRate...", "pure"), ("...InterestRate...", "pure"),
    ("AreaOfRealEstateProperty", "sqm"), ("ElectricityGenerated", "MWh"), ("OreProcessed", "t"), ("ProvedDevelopedReservesVolume", "bbl"),
)
#: the exponents of a kind; "currency" stands for any one currency
DIMENSIONS = {"money": {"currency": 1}, "per_share": {"currency": 1, "shares": -1}, "shares": {"shares": 1}, "pure": {}, "sqm": {"sqm": 1}, "MWh": {"MWh": 1}, "t": {"t": 1}, "bbl": {"bbl": 1}, "K": {"K": 1}}
MISMATCH = "dimension_mismatch"
#: common unit, factor and offset: common value = value * factor + offset
Conversion = tuple[str, Decimal, Decimal]
_NONE = Decimal(0)


def _fits(name: str, pattern: str) -> bool:
    part = pattern.strip(".")
    if pattern.startswith("...") and pattern.endswith("..."):
        return part in name
    return name.endswith(part) if pattern.startswith("...") else name.startswith(part) if pattern.endswith("...") else name == part


@lru_cache(maxsize=1 << 12)
def concept_kind(concept: str | None) -> str | None:
    """The kind of quantity of a concept; None where it is not in the table."""
    return next((kind for pattern, kind in CONCEPTS if _fits(concept or "", pattern)), None)


def exponents(unit: U.Unit) -> dict[str, int]:
    """The exponents of a unit, all currencies as one."""
    out: dict[str, int] = {}
    for d, p in unit.dims:
        d = "currency" if d in U.CURRENCIES else d
        out[d] = out.get(d, 0) + p
    if unit.bare and "currency" not in out:
        out["currency"] = 1
    return out


def _ratio(unit: U.Unit) -> bool:
    """Whether a unit without dimensions is a ratio by name (percent), not only a multiple."""
    return unit.named and not unit.dims and not unit.bare


def kind_of_unit(unit: U.Unit) -> str | None:
    """The kind whose exponents are those of a unit."""
    return next((k for k, v in DIMENSIONS.items() if v == exponents(unit)), None)


def agrees(kind: str, unit: U.Unit) -> bool:
    """Whether a unit measures a kind: equal exponents, or none at all (a multiple); a currency alone also measures an amount per share."""
    own = exponents(unit)
    if own == DIMENSIONS[kind] or kind == "per_share" and own == {"currency": 1}:
        return True
    return not own and not _ratio(unit)


def _currency(unit: U.Unit, *others: str | None) -> str | None:
    """The currency of a unit, else of the first text that names one."""
    named = next((d for d, p in unit.dims if d in U.CURRENCIES and p == 1), None)
    if named:
        return named
    for text in others:
        if text:
            hit = next((d for d, _ in U.parse_unit(text)[0].dims if d in U.CURRENCIES), None)
            if hit:
                return hit
    return None


def _resolve(kind: str | None, unit: U.Unit, note: str | None, canonical: str | None, default: bool) -> Conversion | str | None:
    """The conversion of a recorded unit, a note and the unit declared elsewhere.

    None where no unit is known (``default``: a number without any counts as in the
    common unit), MISMATCH where the exponents are not those of the concept.
    """
    if kind is None:
        kind = kind_of_unit(unit) if exponents(unit) or _ratio(unit) else "money"
    if kind is None or not agrees(kind, unit):
        return MISMATCH
    multiple, word, part = U.parse_note(note)
    factor = unit.scale
    if kind == "K":
        return kind, factor, unit.offset
    if kind in ("money", "per_share"):
        currency = _currency(unit, canonical, word if not unit.named or unit.bare else None, "USD" if default else None)
        if currency is None and part is not None:
            currency = _currency(part)
        if currency is None and unit.bare:
            currency = "USD"
        if currency is None:
            return None
        if kind == "per_share":
            if part is not None and not unit.scaled:
                factor *= part.scale
            return currency + "/shares", factor, _NONE
        if multiple is not None and not unit.scaled:
            factor *= multiple
        return currency, factor, _NONE
    if kind == "pure":
        if not unit.named and part is None and not default and canonical is None:
            return None
        if part is not None and not unit.scaled:
            factor *= part.scale
        return "pure", factor, _NONE
    if not exponents(unit):
        declared = U.parse_unit(canonical)[0] if canonical else U.Unit()
        if kind not in exponents(declared):
            declared = U.parse_unit(word.replace("share counts", "shares"))[0] if word else U.Unit()
        if kind in exponents(declared):
            factor *= declared.scale
        elif not default:
            return None
    if multiple is not None and not unit.scaled:
        factor *= multiple
    elif multiple is not None and unit.scale != 1 and kind != "shares" and not _has_multiple(unit):
        factor *= multiple
    return kind, factor, _NONE


def _has_multiple(unit: U.Unit) -> bool:
    """Whether the unit's scale comes from a multiple, not from the unit's own size (sqft, lb)."""
    sizes = {Decimal(s) for s, d in U.BASE_UNITS.values() if (d, 1) in unit.dims}
    return unit.scale not in sizes


@lru_cache(maxsize=1 << 16)
def recorded(concept: str | None, uom: str | None, note: str | None) -> Conversion | str | None:
    """The conversion of a fact, MISMATCH, or None where neither unit nor note names a unit or multiple."""
    unit, _ = U.parse_unit(uom)
    if not unit.named and not (note or "").strip():
        return None
    return _resolve(concept_kind(concept), unit, note, None, False)


def recorded_factor(concept: str | None, uom: str | None, note: str | None) -> tuple[str, Decimal] | None:
    """Common unit and factor of a fact that has them."""
    hit = recorded(concept, uom, note)
    return hit[:2] if isinstance(hit, tuple) else None


def e4(value: Decimal) -> int | None:
    n = int((value * 10000).to_integral_value(ROUND_HALF_UP))
    return n if -(2**63) <= n < 2**63 else None


def _distinct(b: pa.RecordBatch) -> tuple[list[Conversion | str | None], np.ndarray]:
    """The outcomes of the distinct (concept, unit, note) of a batch, its columns 1 to 3, and which of them each row has."""
    coded = [b.column(i).dictionary_encode() for i in (1, 2, 3)]
    values = [c.dictionary.to_pylist() for c in coded]
    codes = [np.asarray(c.indices.fill_null(len(v)), np.int64) for c, v in zip(coded, values, strict=True)]
    sizes = [len(v) + 1 for v in values]
    combined = (codes[0] * sizes[1] + codes[1]) * sizes[2] + codes[2]
    distinct, inverse = np.unique(combined, return_inverse=True)
    at = lambda v, i: v[i] if i < len(v) else None
    return [recorded(at(values[0], k // sizes[2] // sizes[1]), at(values[1], k // sizes[2] % sizes[1]), at(values[2], k % sizes[2])) for k in map(int, distinct)], inverse


def _where(hits: list, inverse: np.ndarray, holds) -> np.ndarray:
    chosen = np.array([holds(h) for h in hits], bool)
    return np.nonzero(chosen[inverse])[0] if len(hits) else np.empty(0, np.int64)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits, inverse = _distinct(b)
        rows = _where(hits, inverse, lambda h: isinstance(h, tuple) and (h[1] != 1 or h[2] != 0))
        x = np.asarray(b.column(4).take(pa.array(rows)), np.float64)
        finite = np.isfinite(x)
        rows, x = rows[finite], x[finite]
        which = inverse[rows]
        keys = b.column(0).take(pa.array(rows)).cast(pa.string())
        numbers = [e4(Decimal(repr(v)) * hits[k][1] + hits[k][2]) for v, k in zip(x.tolist(), which.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(["facts"] * len(rows), pa.string()), keys, pa.array([hits[k][0] for k in which.tolist()], pa.string()), pa.array(numbers, pa.int64())], schema=_OUT)


def _mismatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits, inverse = _distinct(b)
        rows = pa.array(_where(hits, inverse, lambda h: h == MISMATCH))
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows).cast(pa.string()), b.column(1).take(rows), b.column(2).take(rows)], names=["record_key", "concept", "recorded_unit"])


def printed(display: str | None, concept: str | None, canonical: str | None, note: str | None) -> tuple[str, int | None] | str | None:
    """Common unit and value_e4 of a printed value; MISMATCH, or None where it holds no number."""
    figures, expression, negative = U.split_display(display)
    if figures is None:
        return None
    unit, _ = U.parse_unit(expression)
    kind = concept_kind(concept)
    if unit.bare and not _currency(unit) and not canonical:
        canonical = "USD" if "$" in expression else None
    hit = _resolve(kind, unit, note, canonical, True)
    if not isinstance(hit, tuple):
        return hit
    common, factor, offset = hit
    multiple = unit.scale if unit.scaled else U.parse_note(note)[0]
    # One point before three digits groups beside a German scale word, and in euros without a scale above thousand.
    euros = common == "EUR" and (multiple is None or multiple <= 1000) and not unit.scaled
    european = bool(U.GERMAN.search(expression))
    if figures[0].isalpha():
        value = Decimal(U.number_words(figures.split()))
    else:
        value = U.read_figures(figures, european=european, dotted_groups=euros or european)
    return None if value is None else (common, e4((-value if negative else value) * factor + offset))


def read_display(display: str | None, concept: str | None, canonical: str | None, note: str | None) -> tuple[str, int | None] | None:
    """Common unit and value_e4 of a printed value that has them."""
    hit = printed(display, concept, canonical, note)
    return hit if isinstance(hit, tuple) else None


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(k, *hit) for k, d, c, u, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True) if (hit := read_display(d, c, u, n))]
        yield pa.RecordBatch.from_arrays([pa.array(["evidence_records"] * len(out), pa.string()), *(pa.array([r[i] for r in out], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64())))], schema=_OUT)


def _recorded_rows(facts: DataFrame) -> DataFrame:
    return facts.where("value is not null and (uom is not null or footnote is not null)").select("fact_id", "tag", "uom", "footnote", "value")


def common_units(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts whose number changes, and evidence records whose display holds a number, in common units."""
    shown = evidence.where(F.length(F.trim("raw_display_value")) > 0).select("evidence_id", "raw_display_value", "concept_name", "canonical_unit", "node_text")
    return _recorded_rows(facts).mapInArrow(_facts, SCHEMA).unionByName(shown.mapInArrow(_evidence, SCHEMA))


def mismatches(facts: DataFrame) -> DataFrame:
    """(record_key, concept, recorded_unit) of facts whose unit has other dimensions than their concept."""
    return _recorded_rows(facts).mapInArrow(_mismatched, "record_key string, concept string, recorded_unit string")
