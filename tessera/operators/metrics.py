"""Retrieval, classification and agreement metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import with_checkpoints


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall, precision, reciprocal rank and nDCG at k of each query of ``relevant`` (query_id, id).

    ``ranked`` is (query_id, rank, id); of a repeated id only the first rank counts. A query without hits scores 0.
    """
    first = ranked.where(F.col("rank") <= k).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    hits = first.join(relevant.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("wanted")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = wanted.join(hits, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return j.select("query_id", zero(F.col("hits") / F.col("wanted")).alias("recall"), zero(F.col("hits") / k).alias("precision"), zero(1 / F.col("best")).alias("rr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def means(per_query: DataFrame, category: str | None = None) -> DataFrame:
    """Means over all queries, and by category with a total row named ``all``."""
    aggs = [F.count("*").alias("queries"), *(F.round(F.avg(c), 9).alias(c) for c in ("recall", "precision", "rr", "ndcg"))]
    if category is None:
        return per_query.agg(*aggs)
    rolled = per_query.rollup(category).agg(F.grouping(category).alias("g"), *aggs)
    return rolled.select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(category).cast("string")).alias(category), "queries", "recall", "precision", "rr", "ndcg")


def confusion(df: DataFrame, actual: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(actual, predicted, n) for all pairs of ``classes`` (a small table of class names), zeros included."""
    names = classes.agg(F.sort_array(F.collect_set("class")).alias("names"))
    cells = names.select("names", F.explode("names").alias("actual")).select("actual", F.explode("names").alias("predicted"))
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def scores(matrix: DataFrame) -> DataFrame:
    """precision, recall, F1 and support of each class of a confusion matrix; 0 where undefined."""
    by = lambda c: Window.partitionBy(c)
    cells = matrix.select("*", F.sum("n").over(by("actual")).alias("support"), F.sum("n").over(by("predicted")).alias("named")).where("actual = predicted")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("n"), F.col("named")), ratio(F.col("n"), F.col("support"))
    return cells.select(F.col("actual").alias("class"), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(ratio(2 * p * r, p + r), 9).alias("f1"), "support")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two 0/1 raters; kappa is 1 where chance agreement is complete."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.sum(a).alias("pa"), F.sum(b).alias("pb"), F.count_if(F.col(a) > F.col(b)).alias("over"), F.count_if(F.col(a) < F.col(b)).alias("under"))
    n = F.col("n")
    chance = (F.col("pa") * F.col("pb") + (n - F.col("pa")) * (n - F.col("pb"))) / (n * n)
    po = F.col("same") / n
    return t.select("n", F.round(po, 9).alias("agreement"), F.round(F.when(chance >= 1, 1.0).otherwise((po - chance) / (1 - chance)), 9).alias("kappa"), "over", "under")


def overall(matrix: DataFrame) -> DataFrame:
    """accuracy and macro-F1 (the plain mean of the classes' F1) of a confusion matrix; null without rows."""
    hits = matrix.agg(F.round(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))) / F.nullif(F.sum("n"), F.lit(0)), 9).alias("accuracy"))
    return hits.join(scores(matrix).agg(F.round(F.avg("f1"), 9).alias("macro_f1")), F.lit(True))  # one row each


def rate(df: DataFrame, flag: str, empty: str = "raise") -> DataFrame:
    """(rate, hits, total) of a flag, null counting as false; no row is an error while read, or gives a null rate with empty='null'."""
    t = df.agg(F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("hits"), F.count("*").alias("total"))
    share = F.col("hits") / F.nullif(F.col("total"), F.lit(0))
    if empty == "raise":
        share = F.when(F.col("total") == 0, F.raise_error(F.lit("a rate over no row")).cast("double")).otherwise(share)
    return t.select(F.round(share, 9).alias("rate"), "hits", "total")


def coverage(df: DataFrame, shape: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """A row a shape with the number of rows in each state, 0 where there is none."""
    return df.groupBy(shape).pivot(state, list(states)).count().na.fill(0, list(states))


def first_occurrence(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, document_id, rank, gain): gain 1 where a relevant document first occurs within k, 0 for its further chunks and for others.

    ranked: (query_id, rank, id, document_id); relevant: (query_id, document_id).
    """
    first = ranked.where(F.col("rank") <= k).groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    wanted = relevant.select("query_id", "document_id").distinct().withColumn("r", F.lit(1))
    j = ranked.where(F.col("rank") <= k).join(first, ["query_id", "document_id"]).join(wanted, ["query_id", "document_id"], "left")
    return j.select("query_id", "document_id", "rank", (F.col("r").isNotNull() & (F.col("rank") == F.col("first"))).cast("int").alias("gain"))


def gains(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys gain, lose or stay from before to after; a key that only one side has is an error while read."""
    j = before.select(key, F.col(value).alias("a"), F.lit(1).alias("x")).join(after.select(key, F.col(value).alias("b"), F.lit(1).alias("y")), key, "full_outer")
    whole = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.concat(F.lit("only one side has "), F.col(key).cast("string"))).cast("string"))
    how = whole.when(F.col("b") > F.col("a"), "gain").when(F.col("b") < F.col("a"), "loss").otherwise("same")
    return j.groupBy(how.alias("outcome")).agg(F.count("*").alias("n"))


def first_hits(before: DataFrame, after: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """How many queries of ``relevant`` have their first hit earlier, later, at the same rank, only before, only after or never."""
    hit = lambda r, name: r.where(F.col("rank") <= k).join(relevant.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias(name))
    j = relevant.select("query_id").distinct().join(hit(before, "a"), "query_id", "left").join(hit(after, "b"), "query_id", "left")
    how = F.when(F.col("a").isNull() & F.col("b").isNull(), "never").when(F.col("a").isNull(), "only_after").when(F.col("b").isNull(), "only_before").when(F.col("b") < F.col("a"), "earlier").when(F.col("b") > F.col("a"), "later").otherwise("same")
    return j.groupBy(how.alias("outcome")).agg(F.count("*").alias("queries"))


def numeric_match(got: Column, want: Column, got_unit: Column, want_unit: Column) -> Column:
    """Whether a number and its unit are the expected ones; a missing side is no match."""
    return F.coalesce((got == want) & got_unit.eqNullSafe(want_unit), F.lit(False))


def refused_rightly(should_answer: Column, refused: Column) -> Column:
    """The outcome of a refusal rule: answered, true_refusal, false_refusal or missed_refusal."""
    return F.when(should_answer & ~refused, "answered").when(~should_answer & refused, "true_refusal").when(should_answer & refused, "false_refusal").otherwise("missed_refusal")


def drift(now: Column, then: Column, tolerance: float) -> Column:
    """ok where a number is within a relative tolerance of an earlier one, else drifted; unknown where one is missing."""
    off = F.abs(now - then) / F.greatest(F.abs(then), F.lit(1e-12))
    return F.when(now.isNull() | then.isNull(), "unknown").when(off <= tolerance, "ok").otherwise("drifted")


def deltas(candidate: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta) of two systems' values of the same questions; a question that one lacks is an error while read."""
    j = candidate.select(key, F.col(value).alias("c"), F.lit(1).alias("x")).join(baseline.select(key, F.col(value).alias("b"), F.lit(1).alias("y")), key, "full_outer")
    whole = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.concat(F.lit("only one system has "), F.col(key).cast("string"))).cast("double"))
    return j.select(key, whole.otherwise(F.col("c") - F.col("b")).alias("delta"))


def bootstrap(values: DataFrame, key: str, value: str, iterations: int = 10_000, seed: int = 42, block: int = 1_000_000) -> DataFrame:
    """(delta, low, high): the mean with a 95 % interval by resampling rows; of paired differences (``deltas``) this is the paired bootstrap.

    Rows are cut into blocks by their key. In every iteration all blocks draw the same
    multinomial division of the sample among them, and each draws its part of its own
    rows, so a resample is one of all rows and no block sees another's.
    """
    with_checkpoints(values.sparkSession)
    good = values.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    blocks = max(1, -(-good.count() // block))
    placed = good.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).repartition(blocks, "b").checkpoint()
    sizes = {r.b: r.n for r in placed.groupBy("b").agg(F.count("*").alias("n")).collect()}  # a row a block
    order = sorted(sizes)
    counts = np.array([sizes[b] for b in order], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            b, v = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for one in np.unique(b).tolist():
                held.setdefault(one, []).append(v[b == one])
        for one, parts in held.items():
            x = np.sort(np.concatenate(parts))
            at = order.index(one)
            sums = np.empty(iterations)
            for i in range(iterations):
                share = np.random.default_rng([seed, i]).multinomial(int(counts.sum()), counts / counts.sum())[at] if len(order) > 1 else len(x)
                sums[i] = x[np.random.default_rng([seed, i, one]).integers(0, len(x), share)].sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), pa.array(sums)], names=["i", "s"])

    drawn = placed.select("b", "v").mapInArrow(run, "i bigint, s double").groupBy("i").agg((F.sum("s") / F.lit(float(max(counts.sum(), 1)))).alias("mean"))
    ranked = drawn.select("mean", F.row_number().over(Window.orderBy("mean")).alias("rn"))  # a row an iteration
    low, high = round(0.025 * (iterations - 1)) + 1, round(0.975 * (iterations - 1)) + 1
    ends = ranked.agg(F.max(F.when(F.col("rn") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("rn") == high, F.col("mean"))).alias("high"))
    return placed.agg(F.avg("v").alias("delta")).join(ends, F.lit(True))  # one row each


# The measures by which systems are ranked, in order of their weight.
QUALITY = ("recall_50", "mrr", "ndcg_10", "recall_10")
# What decides between equals, in order; less is better.
ECONOMY = ("chunk_count", "embedding_bytes", "index_bytes", "latency_p95_ms", "build_seconds")


def by_quality(systems: DataFrame) -> DataFrame:
    """Systems with their place by quality; equal ones by economy, fixed chunks before section-aware ones, and name."""
    simple = F.when(F.coalesce("split_mode", F.lit("fixed")) == "fixed", 0).otherwise(1)
    w = Window.orderBy(*(F.desc(c) for c in QUALITY), *(F.coalesce(F.col(c), F.lit(0)) for c in ECONOMY), simple, "row_id")  # a row a system: a handful
    return systems.withColumn("place", F.row_number().over(w))


def tied(recall_hits: int, mrr: tuple[float, float], ndcg: tuple[float, float]) -> bool:
    """Whether a system is practically as good as the reference: one hit apart at most, both intervals around 0."""
    return abs(recall_hits) <= 1 and mrr[0] <= 0 <= mrr[1] and ndcg[0] <= 0 <= ndcg[1]


def winner(systems: list[dict], reference: str, against: dict[str, dict]) -> tuple[str | None, str]:
    """(row_id, why) of a round: the best by quality, the most economical of practical equals, or nobody.

    ``against`` has recall_hits, mrr and ndcg (intervals of the difference to the
    reference) of every other system. Nobody wins (``regression``) where the best
    raises the first measure but one of the intervals lies below 0.
    """
    named = {s["row_id"]: s for s in systems}
    if reference not in named:
        raise ValueError(f"{reference} is not among the systems")
    economy = lambda s: (*(s.get(c) or 0 for c in ECONOMY), s.get("split_mode", "fixed") != "fixed")
    equals = [named[reference], *(named[r] for r, x in against.items() if r != reference and tied(x["recall_hits"], x["mrr"], x["ndcg"]))]
    best = max(systems, key=lambda s: tuple(s[c] for c in QUALITY))
    if best["row_id"] == reference or best in equals:
        chosen = min(equals, key=economy)["row_id"]
        return chosen, "best" if len(equals) == 1 else "economy"
    x = against[best["row_id"]]
    if best[QUALITY[0]] > named[reference][QUALITY[0]] and (x["mrr"][1] < 0 or x["ndcg"][1] < 0):
        return None, "regression"
    return best["row_id"], "improvement"
