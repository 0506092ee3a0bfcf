"""Delivered lines parsed into typed rows, or set aside with a reason.

Every line gives one row: either its typed fields or a reason with the byte
offset of the fault. A null line counts as an empty one; lines of a file of an
unknown kind get the reason ``unknown_file``. No shuffle. A row of the table is a
whole record, so the tokenizer composes its chunks within a batch and no further.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fsm

# The fields of each kind of file.
LAYOUTS = {
    "num": ("adsh", "tag", "version", "ddate", "qtrs", "uom", "coreg", "segments", "value"),
    "sub": ("adsh", "cik", "name", "form", "fy", "fp", "period", "filed"),
}
SCHEMA = "line_id bigint, file_name string, kind string, reason string, fault_offset int, fields array<string>"
_OUT = pa.schema([("line_id", pa.int64()), ("file_name", pa.string()), ("kind", pa.string()), ("reason", pa.string()), ("fault_offset", pa.int32()), ("fields", pa.list_(pa.string()))])
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_QTRS = re.compile(r"[0-9]{1,2}")
_FY = re.compile(r"(?:19|20)[0-9]{2}")
#: checks of a field by kind, in the order in which a reason is chosen
CHECKS = {"num": (("value", _NUMBER, "bad_value"), ("qtrs", _QTRS, "bad_qtrs")), "sub": (("fy", _FY, "bad_fy"),)}


def kind_of(file_name: str | None) -> str | None:
    base = (file_name or "").rsplit("/", 1)[-1].lower()
    return base[:-4] if base.endswith(".txt") and base[:-4] in LAYOUTS else None


def parse_lines(lines: list[str | None], kinds: list[str | None], chunk: int = 512) -> list[tuple[str | None, int | None, list[str] | None]]:
    """(reason, offset of the fault in bytes, fields) of each line; offset and fields are null where there is none."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in lines]
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    ends = np.cumsum(sizes) - 1
    buffer = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    broken, separators, owner = fsm.tokenize(buffer, ends, chunk=chunk)
    first = np.searchsorted(owner, np.arange(len(raw) + 1))
    begins = ends - sizes + 1
    out: list[tuple[str | None, int | None, list[str] | None]] = []
    for i, (line, kind) in enumerate(zip(raw, kinds, strict=True)):
        if broken[i] >= 0:
            out.append(("quoting", int(broken[i]), None))
            continue
        if kind is None:
            out.append(("unknown_file", 0, None))
            continue
        names, cuts = LAYOUTS[kind], separators[first[i] : first[i + 1]] - begins[i]
        if len(cuts) + 1 != len(names):
            out.append(("column_count", len(line) if len(cuts) + 1 < len(names) else int(cuts[len(names) - 1]), None))
            continue
        bounds = [-1, *cuts.tolist(), len(line)]
        fields = [line[a + 1 : b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
        fields = [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in fields]
        for name, pattern, reason in CHECKS[kind]:
            k = names.index(name)
            if fields[k] and not pattern.fullmatch(fields[k]):
                out.append((reason, bounds[k] + 1, None))
                break
        else:
            out.append((None, None, fields))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column(1).to_pylist()
        kinds = [kind_of(x) for x in names]
        rows = parse_lines(b.column(2).to_pylist(), kinds)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string()), *(pa.array([r[i] for r in rows], _OUT.field(i + 3).type) for i in range(3))], schema=_OUT)


def parsed(lines: DataFrame) -> DataFrame:
    """Every line with its reason and fault offset, or with its fields."""
    return lines.select(F.col("line_id").cast("bigint").alias("line_id"), "file_name", "line").mapInArrow(_parse, SCHEMA)


def rejected(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("reason is not null").select("line_id", "reason")


def _typed(kind: str, lines: DataFrame, casts: dict[str, str]) -> DataFrame:
    own = F.lower(F.substring_index("file_name", "/", -1)) == f"{kind}.txt"  # before the lines go to Python
    good = parsed(lines.where(own)).where((F.col("kind") == kind) & F.col("reason").isNull())
    field = lambda i: F.when(F.col("fields")[i] != "", F.col("fields")[i])
    return good.select("line_id", *(F.expr(f"try_cast(nullif(fields[{i}], '') as {casts[n]})").alias(n) if n in casts else field(i).alias(n) for i, n in enumerate(LAYOUTS[kind])))


def typed_facts(lines: DataFrame) -> DataFrame:
    """The facts of loadable num lines; blank fields are null, a value beyond a double is infinite."""
    return _typed("num", lines, {"qtrs": "int", "value": "double"})


def typed_submissions(lines: DataFrame) -> DataFrame:
    """The submissions of loadable sub lines; blank fields are null, a cik that is no integer is null."""
    return _typed("sub", lines, {"cik": "bigint", "fy": "int"})
