"""Search: exact vector search, BM25, fusion, rerank, confidence.

Vector search multiplies blocks: the queries, whose size is checked, are sent to
the vectors; every batch of vectors gives its best k a query, and these partial
results are merged. Nothing of the corpus is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: bytes of query vectors sent out at once; more queries go in several blocks
QUERY_BYTES = 64 << 20
_HITS = "query_id bigint, id bigint, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row; equal ones (to 9 places) at the edge in order of key, as in the merge."""
    rows, columns = [], []
    place = max(scores.shape[1] - k, 0)
    edges = np.partition(scores, place, axis=1)[:, place]
    for r, edge in enumerate(edges):
        # Scores that only differ in rounding belong to the same edge.
        near = np.nonzero(scores[r] >= edge - 1e-9)[0]
        near = near[np.isfinite(scores[r, near])]
        if len(near) > k:
            near = near[np.lexsort((keys[near], -np.round(scores[r, near], 9)))[:k]]
        rows.append(np.full(len(near), r))
        columns.append(near)
    return np.concatenate(rows).astype(np.int64), np.concatenate(columns).astype(np.int64)


def _scan(shared, k: int, skip_self: bool, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            keys = np.asarray(b.column(0), np.int64)
            flat = np.asarray(b.column(1).flatten(), np.float64)
            x = _unit(flat.reshape(len(keys), dims))
            for at in range(0, len(ids), 256):
                scores = q[at : at + 256] @ x.T
                if skip_self:
                    scores[ids[at : at + 256][:, None] == keys[None, :]] = -np.inf
                r, c = _best(scores, keys, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256][r]), pa.array(keys[c]), pa.array(scores[r, c])], names=["query_id", "id", "score"])

    return run


def valid_vectors(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Vectors of the right length without nulls, NaN or infinities."""
    ok = (F.size(vector) == dims) & ~F.exists(vector, lambda v: F.coalesce(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return df.where(F.coalesce(ok, F.lit(False)))


def knn(vectors: DataFrame, queries: DataFrame, k: int, dims: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """(query_id, rank, id, score = cosine) of the k best; equal scores (to 9 places) in order of id. Filter before for a pre-filtered search."""
    if k < 1:
        raise ValueError("k is 1 at least")
    spark = vectors.sparkSession
    rows = valid_vectors(queries, vector, dims).select(F.col(key).cast("bigint"), vector)
    corpus = valid_vectors(vectors, vector, dims).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    limit = max(1, QUERY_BYTES // (8 * dims))
    out, ids, block = None, [], []

    def add(out: DataFrame | None) -> DataFrame:
        x = np.array(block, np.float64).reshape(len(block), dims)
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), _unit(x)))
        part = corpus.mapInArrow(_scan(shared, k, skip_self, dims), _HITS)
        return part if out is None else out.unionByName(part)

    for row in rows.toLocalIterator():
        ids.append(row[0])
        block.append(row[1])
        if len(ids) == limit:
            out, ids, block = add(out), [], []
    if ids or out is None:
        out = add(out)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def norm_audit(vectors: DataFrame, vector: str = "embedding", tolerance: float = 1e-3) -> DataFrame:
    square = F.aggregate(F.transform(vector, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    off = F.abs(F.sqrt(square) - 1) > tolerance
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(off).alias("not_unit"), F.min(F.size(vector)).alias("least_dims"), F.max(F.size(vector)).alias("most_dims"))


def _once(stream: DataFrame) -> DataFrame:
    """(query_id, id, rank) of a stream, or an error while read where a query has an id twice."""
    one = stream.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("an id is twice in the stream of query "), F.col("query_id").cast("string"))).cast("int")
    return one.select("query_id", "id", F.when(F.col("n") > 1, twice).otherwise(F.col("rank")).alias("rank"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, limit: int = 50) -> DataFrame:
    """Reciprocal rank fusion of two (query_id, rank, id); a missing side adds nothing.

    Equal sums are ordered by the better rank, the dense rank, the sparse rank and the id, missing ranks last.
    An id twice in a stream of a query is an error while read.
    """
    far = 1 << 30
    dense, sparse = (_once(d) for d in (dense, sparse))
    both = dense.select("query_id", "id", F.col("rank").alias("dense_rank")).join(sparse.select("query_id", "id", F.col("rank").alias("sparse_rank")), ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("dense_rank") + part("sparse_rank"))
    d, s = F.coalesce("dense_rank", F.lit(far)), F.coalesce("sparse_rank", F.lit(far))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.least(d, s), d, s, "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "dense_rank", "sparse_rank", F.round("score", 9).alias("score"))


def rerank(candidates: DataFrame, scores: DataFrame, k: int, base_k: int) -> DataFrame:
    """The first ``base_k`` candidates (query_id, rank, id) by new scores (query_id, id, score); equal scores keep their order, the old rank stays as base_rank.

    More results than candidates asked for is an error; a score that is missing, NaN
    or infinite is one while read.
    """
    if k > base_k:
        raise ValueError(f"{k} results of {base_k} candidates")
    joined = candidates.where(F.col("rank") <= base_k).join(scores, ["query_id", "id"], "left")
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    sound = F.when(bad, F.raise_error(F.concat(F.lit("no finite score of "), F.col("id").cast("string"))).cast("double")).otherwise(F.col("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return joined.withColumn("score", sound).select("query_id", "id", "score", F.col("rank").alias("base_rank"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def same_candidates(before: DataFrame, after: DataFrame, relevant: DataFrame, k: int = 50, tolerance: float = 1e-12) -> DataFrame:
    """(query_id, before, after, same): recall at k, which reordering the candidates must not change."""

    def recall(ranked: DataFrame, name: str) -> DataFrame:
        hits = ranked.where(F.col("rank") <= k).select("query_id", "id").distinct().join(relevant.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n"))
        wanted = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("all"))
        return wanted.join(hits, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.col("all")).alias(name))

    j = recall(before, "before").join(recall(after, "after"), "query_id")
    return j.withColumn("same", F.abs(F.col("before") - F.col("after")) <= tolerance)


def shaped(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (query_id, rank, id, score) as results: citation_id of document and local id, the company, or its number where it has no name.

    chunks: (id, document_id, local_id, company, cik, text).
    """
    name = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.concat(F.lit("CIK "), F.col("cik").cast("string")))
    return hits.join(chunks, "id").select("query_id", "rank", F.concat_ws("::", "document_id", "local_id").alias("citation_id"), name.alias("company"), "document_id", "text", "score")


def confidence(ranked: DataFrame) -> DataFrame:
    """top1, mean of the first three and lead over the fifth (or last) score of each query."""
    last = F.max_by("score", F.when(F.col("rank") <= 5, F.col("rank")))
    return ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.round(F.avg(F.when(F.col("rank") <= 3, F.col("score"))), 6).alias("mean3"), F.round(F.max(F.when(F.col("rank") == 1, F.col("score"))) - last, 6).alias("lead"))


def refused(features: DataFrame, threshold: float) -> DataFrame:
    """Confidence features with whether the answer is refused: the best score lies below the threshold, or there is none."""
    return features.withColumn("refused", F.coalesce(F.col("top1") < threshold, F.lit(True)))


def youden(scored: DataFrame, blocks: int = 64) -> DataFrame:
    """The threshold on top1 that separates answerable (good = 1) from other queries best; the least of equals.

    Counts below each distinct score are running sums within blocks of scores, plus those of the blocks before.
    """
    counts = scored.where("top1 is not null").groupBy("top1").agg(F.count_if(F.expr("good = 1")).alias("pos"), F.count_if(F.expr("good = 0")).alias("neg"))
    ends = counts.agg(F.min("top1").alias("low"), F.max("top1").alias("high"))
    block = F.least(F.lit(blocks - 1), F.floor((F.col("top1") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) * blocks))
    cut = counts.join(F.broadcast(ends), F.lit(True)).withColumn("block", F.coalesce(block, F.lit(0)))  # one row
    sums = cut.groupBy("block").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    w, everything = Window.orderBy("block"), Window.partitionBy()  # a row a block
    before = sums.select("block", (F.sum("p").over(w) - F.col("p")).alias("before_p"), (F.sum("n").over(w) - F.col("n")).alias("before_n"), F.sum("p").over(everything).alias("all_pos"), F.sum("n").over(everything).alias("all_neg"))
    within = Window.partitionBy("block").orderBy("top1").rowsBetween(Window.unboundedPreceding, -1)
    run = cut.select("block", "top1", F.coalesce(F.sum("pos").over(within), F.lit(0)).alias("p"), F.coalesce(F.sum("neg").over(within), F.lit(0)).alias("n")).join(F.broadcast(before), "block")
    j = F.round((F.col("before_n") + F.col("n")) / F.nullif(F.col("all_neg"), F.lit(0)) - (F.col("before_p") + F.col("p")) / F.nullif(F.col("all_pos"), F.lit(0)), 9)
    return run.select(F.col("top1").alias("threshold"), j.alias("j")).orderBy(F.desc("j"), "threshold").limit(1)


def complementarity(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """How many hits of each query both systems have, and each alone."""
    both = dense.select("query_id", "id", F.lit(1).alias("d")).join(sparse.select("query_id", "id", F.lit(1).alias("s")), ["query_id", "id"], "full_outer")
    return both.groupBy("query_id").agg(F.count_if(F.expr("d = 1 and s = 1")).alias("both"), F.count_if(F.expr("d = 1 and s is null")).alias("dense_only"), F.count_if(F.expr("s = 1 and d is null")).alias("sparse_only"))


def movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many ids moved up, down or stayed, entered or left."""
    both = before.select("query_id", "id", F.col("rank").alias("a")).join(after.select("query_id", "id", F.col("rank").alias("b")), ["query_id", "id"], "full_outer")
    how = F.when(F.col("a").isNull(), "entered").when(F.col("b").isNull(), "left").when(F.col("b") < F.col("a"), "up").when(F.col("b") > F.col("a"), "down").otherwise("same")
    return both.groupBy(how.alias("movement")).agg(F.count("*").alias("n"))
