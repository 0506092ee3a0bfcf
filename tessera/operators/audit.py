"""Data-quality audits: each is one aggregation over a table, or one join of reduced keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filled(c: str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", "")) > 0, F.lit(False))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, average_length) of all columns in one pass; an empty table has averages of null."""
    sums = [x for c in columns for x in (F.count_if(filled(c)).alias(f"{c}__n"), F.avg(F.when(filled(c), F.length(c))).alias(f"{c}__l"))]
    row = df.agg(*sums)
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}__n").alias("filled"), F.col(f"{c}__l").alias("average_length")) for c in columns))))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """How many keys repeat, and how many rows have such a key."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("keys"))


def mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the least one of equals."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def top(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is last in order; the columns are part of the order, so ties are settled."""
    last = df.groupBy(key).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("x"))
    return last.select(key, *(F.col(f"x.{c}").alias(c) for c in columns))


#: positions (from 0) of a percentile in n sorted values, by convention
CONVENTIONS = {
    "share_of_count": lambda p, n: F.floor(F.lit(p) * n),  # s[int(p n)]
    "share_of_last": lambda p, n: F.floor(F.lit(p) * (n - 1)),  # s[int(p (n - 1))]
    "nearest": lambda p, n: F.bround(F.lit(p) * (n - 1)),  # s[round(p (n - 1))], halves to even
}


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], convention: str = "nearest", least: int = 0) -> DataFrame:
    """Positional percentiles by a convention; none is interpolated. ``least``: a group of fewer values has null.

    Equal values are counted before anything is ordered, so a hot key costs its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__rows"))
    w = Window.partitionBy(key)
    placed = counts.select(key, value, F.sum("__rows").over(w.orderBy(value)).alias("__upto"), "__rows", F.sum("__rows").over(w).alias("__all"))

    def at(share: float) -> Column:
        place = F.least(CONVENTIONS[convention](share, F.col("__all")), F.col("__all") - 1) + 1
        return F.max(F.when((F.col("__upto") >= place) & (F.col("__upto") - F.col("__rows") < place) & (F.col("__all") >= least), F.col(value)))

    return placed.groupBy(key).agg(*(at(s).alias(name) for name, s in shares.items()))


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the middle value, or the mean of the two in the middle."""
    numbers = df.withColumn(value, F.col(value).cast("double"))
    both = percentiles(numbers, key, value, {"m": 0.5}, "share_of_last").unionByName(percentiles(numbers, key, value, {"m": 0.5}, "share_of_count"))
    return both.groupBy(key).agg(F.avg("m").alias("median"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """(least, median, p95, most, keys) of the numbers of rows a key; the number of distinct counts is small, so one task orders them."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    ends = sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("keys"))
    return ends.join(percentiles(sizes, "g", "n", {"median": 0.5, "p95": 0.95}, "share_of_count").drop("g"), F.lit(True), "left").select("least", "median", "p95", "most", "keys")


def distinct_tuples(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many different tuples there are, those with nulls included."""
    return df.agg(F.countDistinct(F.struct(*columns)).alias("tuples"))


def inconsistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values, greatest) of keys with different values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("values"), F.max(value).alias("greatest")).where("values > 1")


def drifted_headers(headers: dict[str, list[str]]) -> list[tuple[str, list[str], list[str]]]:
    """(archive, columns that the first archive lacks, columns of the first that it lacks) of archives whose header differs."""
    if not headers:
        return []
    first = next(iter(headers.values()))
    return [(name, [c for c in h if c not in first], [c for c in first if c not in h]) for name, h in headers.items() if set(h) != set(first)]


def suite(df: DataFrame, name: str, checks: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(suite, check_name, bad, total, level) of checks (a condition that every row must meet, shares of bad rows that warn and fail), in one pass.

    A null condition counts as not met. PASS, WARN, FAIL, or SKIP for an empty table.
    """
    one = df.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, (c, _, _) in checks.items()), F.count("*").alias("total"))
    rows = F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("bad"), F.col("total").alias("total"), F.lit(float(w)).alias("warn"), F.lit(float(f)).alias("fail")) for n, (_, w, f) in checks.items())))
    share = F.col("bad") / F.nullif(F.col("total"), F.lit(0))
    level = F.when(share.isNull(), "SKIP").when(share > F.col("fail"), "FAIL").when(share > F.col("warn"), "WARN").otherwise("PASS")
    return one.select(rows).select(F.lit(name).alias("suite"), "check_name", "bad", "total", level.alias("level"))


def latest_status(events: DataFrame) -> DataFrame:
    """(run_id, status, written, expected) of runs by their events (run_id, seq, status, expected): the last status.

    A run is complete only if as many rows were written as expected; a completed one
    takes no further status.
    """
    done = events.where("status = 'complete'").groupBy("run_id").agg(F.min("seq").alias("done_at"))
    open_events = events.join(done, "run_id", "left").where("done_at is null or seq <= done_at")
    last = open_events.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.max("expected").alias("expected"), F.sum(F.coalesce("written", F.lit(0))).alias("written"))
    status = F.when((F.col("status") == "complete") & (F.col("written") != F.coalesce("expected", F.col("written"))), "partial").otherwise(F.col("status"))
    return last.select("run_id", status.alias("status"), "written", "expected")


def fingerprint(df: DataFrame) -> DataFrame:
    """An order-free fingerprint: the rows and the sum of their hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hashes"))


def integrity(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children, those with a key and those whose key exists; the parent's keys are made distinct first."""
    keys = parent.select(F.col(parent_key).alias(child_key)).where(F.col(child_key).isNotNull()).distinct().withColumn("there", F.lit(1))
    return child.join(keys, child_key, "left").agg(F.count("*").alias("children"), F.count(child_key).alias("with_key"), F.count("there").alias("found"))


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The share of right's distinct keys that left has."""
    r = right.select(key).where(F.col(key).isNotNull()).distinct()
    hit = r.join(left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("there", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("keys"), F.count("there").alias("shared"), (F.count("there") / F.count("*")).alias("share"))


def alignment_cause(filings: DataFrame, submissions: DataFrame) -> DataFrame:
    """Why a filing (cik, year) has no submission of its year: an ordered decision, one row a filing.

    matched, off_by_one (a neighbouring year), other_years (with the range) or no_company.
    """
    years = submissions.where("fiscal_year is not null").select("cik", F.col("fiscal_year").alias("have")).distinct()
    span = years.groupBy("cik").agg(F.min("have").alias("first_year"), F.max("have").alias("last_year"))
    exact = years.select("cik", F.col("have").alias("year"), F.lit(1).alias("exact"))
    near = years.select("cik", F.explode(F.array(F.col("have") - 1, F.col("have") + 1)).alias("year")).distinct().withColumn("near", F.lit(1))
    joined = filings.join(span, "cik", "left").join(exact, ["cik", "year"], "left").join(near, ["cik", "year"], "left")
    cause = F.when(F.col("exact") == 1, "matched").when(F.col("near") == 1, "off_by_one").when(F.col("first_year").isNotNull(), "other_years").otherwise("no_company")
    return joined.select("document_id", "cik", "year", cause.alias("cause"), "first_year", "last_year")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule (a condition that must hold; null counts as broken) that a row breaks."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def verdicts(metrics: DataFrame, warn: float, fail: float) -> DataFrame:
    """PASS, WARN or FAIL of each (check_name, bad, total); SKIP where there is nothing to check."""
    share = F.col("bad") / F.nullif(F.col("total"), F.lit(0))
    level = F.when(share.isNull(), "SKIP").when(share > fail, "FAIL").when(share > warn, "WARN").otherwise("PASS")
    return metrics.select("check_name", "bad", "total", level.alias("level"))
