"""References to records that are missing, deleted or not there yet.

Parent keys become integers within a space (adsh: one space; chunk: a space for
each document). Sorted keys are compressed into contiguous runs, cut at every
``BUCKET`` keys so that a run, and the runs of a bucket, have a proven bound. A
reference joins the runs of its bucket and is matched as of: the run with the
greatest start at or before the key; beyond the run's end it is an orphan.

Only compressed runs and slim references are shuffled. Parents are reduced before
the shuffle. References are counted by bucket first: those of a bucket with more
than ``HOT`` are spread over as many salts as it needs, and only the runs of such
buckets are copied.

Null and blank keys are no references. A key that has no integer form is a space
of its own with one key, so that it meets the parent of the same text. A child
without a time is only checked for existence; its period is null. Of a parent
delivered again the earliest arrival and removal count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 256
#: references of a bucket in one task
HOT = 1_000_000
COLUMNS = ("child_table", "child_key", "parent_key", "kind", "period")
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _folded(key: Column) -> Column:
    """Full-width characters, dashes, blanks, invisible characters and brackets made plain; lower case."""
    plain = F.translate(key, _WIDE, _PLAIN)
    plain = F.regexp_replace(plain, "[\\u2010-\\u2015\\u2212]", "-")
    return F.lower(F.regexp_replace(plain, "[\\s\\p{Z}\\p{Cf}\\[\\](){}<>\\u3010\\u3011]", ""))


def _says_something(column: str) -> Column:
    """Not null, and a letter or digit in it; asked of the raw key, so that nothing is folded for it."""
    return F.col(column).rlike("[\\p{L}\\p{N}]")


def _plainly(df: DataFrame, column: str, usual: str) -> DataFrame:
    """The column ``folded``; a key already in its usual form, as nearly all are, skips the folding."""
    return df.withColumn("folded", F.when(F.col(column).rlike(usual), F.col(column)).otherwise(_folded(F.col(column))))


def _by_text(keyed: DataFrame) -> DataFrame:
    """A key without integer form as a space of its text, with the one key 0. Neither is ever null, so that no join asks for that, folding once more."""
    space = F.when(F.col("key").isNotNull(), F.col("space")).otherwise(F.concat(F.lit("?"), F.col("folded")))
    return keyed.withColumns({"space": F.coalesce(space, F.lit("?")), "key": F.coalesce("key", F.lit(0).cast("bigint"))})


def with_adsh(df: DataFrame, column: str) -> DataFrame:
    """``space``, ``key`` and ``usual`` of an accession number: one space, its 18 digits, 10-2-6 digits."""
    plain = _plainly(df, column, "^[0-9]{10}-[0-9]{2}-[0-9]{6}$")
    digits = plain.withColumn("digits", F.when(F.length("folded") == 20, F.concat(F.substring("folded", 1, 10), F.substring("folded", 12, 2), F.substring("folded", 15, 6))).otherwise(F.regexp_replace("folded", "-", "")))
    key = F.when(F.length("digits") == 18, F.col("digits").try_cast("bigint"))
    usual = F.concat_ws("-", F.substring("digits", 1, 10), F.substring("digits", 11, 2), F.substring("digits", 13, 6))
    keyed = digits.withColumns({"space": F.lit(""), "key": key})
    return _by_text(keyed.withColumn("usual", F.when(F.col("key").isNotNull(), usual).otherwise(F.col("folded")))).drop("folded", "digits")


_CHUNK = "^(.*?)::chunk0*([0-9]{1,18})$"


def with_chunk(df: DataFrame, column: str) -> DataFrame:
    """``space``, ``key`` and ``usual`` of a chunk key: its document, its ordinal, document::chunkN."""
    plain = _plainly(df, column, "^[a-z0-9_.\\-]+::chunk[0-9]{1,18}$")
    keyed = plain.withColumns({"space": F.regexp_extract("folded", _CHUNK, 1), "key": F.regexp_extract("folded", _CHUNK, 2).try_cast("bigint")})
    usual = F.concat("space", F.lit("::chunk"), F.col("key").cast("string"))
    return _by_text(keyed.withColumn("usual", F.when(F.col("key").isNotNull(), usual).otherwise(F.col("folded")))).drop("folded")


def runs(parents: DataFrame) -> DataFrame:
    """(space, bucket, runs): runs are (start, end, arrivals, removals), the arrays by position in the run.

    parents: space, key, arrived, removed. A bucket holds at most BUCKET keys.
    """
    keys = parents.where("key is not null").groupBy("space", "key").agg(F.min("arrived").alias("arrived"), F.min("removed").alias("removed"))
    sorted_keys = keys.groupBy("space", F.shiftright("key", 8).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("key", "arrived", "removed"))).alias("k"))
    compress = """
        aggregate(k, cast(array() as array<struct<start: bigint, end: bigint, arrived: array<timestamp_ntz>, removed: array<timestamp_ntz>>>),
            (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).end = x.key - 1,
                concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', x.key,
                    'arrived', array_append(element_at(acc, -1).arrived, x.arrived), 'removed', array_append(element_at(acc, -1).removed, x.removed)))),
                array_append(acc, named_struct('start', x.key, 'end', x.key, 'arrived', array(x.arrived), 'removed', array(x.removed)))))"""
    return sorted_keys.select("space", "bucket", F.expr(compress).alias("runs"))


def orphans(children: DataFrame, parents: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """Orphans among children (child_table, child_key, space, key, parent_key, at) of parents (space, key, arrived, removed); counts: (space, key, n) of the children's keys."""
    refs = children.withColumn("bucket", F.shiftright("key", 8))
    # At most a row for every ``hot`` references: a million rows of 40 bytes for 10^12 of them, so it may be sent to all tasks.
    spread = counts.groupBy("space", F.shiftright("key", 8).alias("bucket")).agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("space", "bucket", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    spread, last = F.broadcast(spread), F.coalesce("salts", F.lit(1)) - 1
    copied = runs(parents).join(spread, ["space", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")
    salted = refs.join(spread, ["space", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("child_key"), last + 1).cast("int")).drop("salts")
    joined = salted.join(copied, ["space", "bucket", "salt"], "left")
    found = joined.withColumn("run", F.when(F.size("runs") > 0, F.expr("try_element_at(filter(runs, r -> r.start <= key), -1)")))
    inside = F.col("run").isNotNull() & (F.col("key") <= F.col("run.end"))
    place = (F.col("key") - F.col("run.start") + 1).cast("int")
    found = found.withColumns({"inside": inside, "arrived": F.when(inside, F.try_element_at("run.arrived", place)), "removed": F.when(inside, F.try_element_at("run.removed", place))})
    kind = F.when(~F.coalesce("inside", F.lit(False)), "missing").when(F.col("arrived") > F.col("at"), "late").when(F.col("removed") <= F.col("at"), "deleted")
    return found.withColumn("kind", kind).where("kind is not null").select("child_table", "child_key", "parent_key", "kind", F.date_format("at", "yyyy-MM").alias("period"))


def _ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def _children(keyed: DataFrame, child_table: str, child_key: str, at: str) -> DataFrame:
    return keyed.select(F.lit(child_table).alias("child_table"), F.col(child_key).cast("string").alias("child_key"), "space", "key", F.col("usual").alias("parent_key"), _ntz(at).alias("at"))


def fact_orphans(facts: DataFrame, submissions: DataFrame, hot: int = HOT) -> DataFrame:
    keyed = facts.where(_says_something("adsh"))
    children = _children(with_adsh(keyed.select("fact_id", "adsh", "loaded_at"), "adsh"), "facts", "fact_id", "loaded_at")
    # Equal keys are counted as they are written, before they are folded.
    counts = with_adsh(keyed.groupBy("adsh").agg(F.count("*").alias("n")), "adsh")
    parents = with_adsh(submissions.select("adsh", "loaded_at", "withdrawn_at"), "adsh").select("space", "key", _ntz("loaded_at").alias("arrived"), _ntz("withdrawn_at").alias("removed"))
    return orphans(children, parents, counts, hot)


def citation_orphans(runs_table: DataFrame, chunks: DataFrame, child_table: str, hot: int = HOT) -> DataFrame:
    """One row a case and cited chunk, however often the case cites it."""
    cited = runs_table.select("case_id", "run_ts", F.explode("citation_checks.chunk_id").alias("chunk_id")).where(_says_something("chunk_id"))
    children = _children(with_chunk(cited, "chunk_id"), child_table, "case_id", "run_ts")
    parents = with_chunk(chunks.select("chunk_id", "indexed_at", "removed_at"), "chunk_id").select("space", "key", _ntz("indexed_at").alias("arrived"), _ntz("removed_at").alias("removed"))
    counts = with_chunk(cited.groupBy("chunk_id").agg(F.count("*").alias("n")), "chunk_id")
    return orphans(children, parents, counts, hot).distinct()


def by_month(found: DataFrame) -> DataFrame:
    return found.groupBy("child_table", "period", "kind").agg(F.count("*").alias("orphans"), F.countDistinct("parent_key").alias("parents"))
