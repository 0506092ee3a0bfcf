"""Full-text search: analysis of words, a stored inverted index, BM25, and a deterministic embedding of texts.

Texts are counted in one narrow pass (a text's words never leave its task as single
rows). The index is a table of postings, spread by term and sorted by it within each
file: a query reads the row groups that may hold its terms.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import with_checkpoints

MOST_CHARS = 40
_TERM = re.compile(r"[a-z0-9]+")
# Words that say nothing about a text.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
# Letters with marks and the letters they are read as.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
_FOLD = str.maketrans(_MARKED, _PLAIN) | {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe"}


@dataclass(frozen=True)
class Analysis:
    """How words are made of a text; all off, words are lower-case runs of ASCII letters and digits of at most 40 characters."""

    fold: bool = False
    stop: bool = False
    stem: bool = False


@lru_cache(maxsize=1 << 16)
def stemmed(word: str) -> str:
    """An English word without its plural, -ed or -ing ending, a closing y as i (the first step of the usual suffix stripping)."""
    vowel = r"(?:[aeiou]|(?<=[^aeiou])y)"
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if re.search(vowel + r".*[^aeiou]", word[:-3]):
            word = word[:-1]
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and re.search(vowel, word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                word = word[:-1]
    if word.endswith("y") and re.search(vowel, word[:-1]):
        word = word[:-1] + "i"
    return word


def words(text: str, how: Analysis = Analysis()) -> list[str]:
    text = text.lower()
    if how.fold:
        text = text.translate(_FOLD)
    out = [w for w in _TERM.findall(text) if len(w) <= MOST_CHARS]
    if how.stop:
        dropped = _stop_words()
        out = [w for w in out if w not in dropped]
    return [stemmed(w) for w in out] if how.stem else out


@lru_cache(maxsize=1)
def _stop_words() -> frozenset[str]:
    return frozenset(STOP_WORDS.split())


def sanitized(query: str) -> str:
    """A query without double quotes; one that is no text or blank is an error."""
    if not isinstance(query, str):
        raise TypeError("a query is a text")
    query = query.replace('"', "").strip()
    if not query:
        raise ValueError("a query must say something")
    return query


def postings(texts: DataFrame, key: str, text: str, how: Analysis = Analysis()) -> DataFrame:
    """(key, term, tf, length, first): the words of each text with their counts, the text's number of words and 1 on one posting of each text. Null and wordless texts have none; a key stands for one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, counts, lengths, first = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = words(t, how)
                count = Counter(found)
                at += [i] * len(count)
                terms += count
                counts += count.values()
                lengths += [len(found)] * len(count)
                first += [1, *[0] * (len(count) - 1)] if count else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(first, pa.int64())], names=[key, "term", "tf", "length", "first"])

    slim = texts.where(F.col(text).isNotNull()).select(key, F.col(text).cast("string").alias("__text"))
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, term string, tf bigint, length bigint, first bigint")


class Index:
    """A stored index: postings, and the number and mean length of the texts."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        totals = spark.read.parquet(f"{path}/totals").first()
        self.docs, self.mean = float(totals.docs), float(totals.mean or 1.0)

    @classmethod
    def write(cls, texts: DataFrame, key: str, text: str, path: str, how: Analysis = Analysis()) -> Index:
        """Builds the index at ``path``, which must not exist."""
        spark = texts.sparkSession
        made = postings(texts, key, text, how)
        # A term that many texts have goes to several files.
        spread = made.repartition(F.col("term"), F.pmod(F.xxhash64(key), F.lit(4)))
        spread.sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        total = stored.agg(F.coalesce(F.sum("first"), F.lit(0)).alias("docs"), F.sum("tf").alias("words"))
        total.select("docs", (F.col("words") / F.nullif(F.col("docs"), F.lit(0))).alias("mean")).coalesce(1).write.parquet(f"{path}/totals")
        return cls(spark, path, key)

    @classmethod
    def of(cls, texts: DataFrame, key: str, text: str, how: Analysis = Analysis()) -> Index:
        """The index of a table in the shared folder, built if it is not there; told by the table's files, their sizes and times, and the analysis."""
        spark = texts.sparkSession
        folder = with_checkpoints(spark)
        jvm, files = spark._jvm, []
        for name in sorted(texts.inputFiles()):
            at = jvm.org.apache.hadoop.fs.Path(name)
            status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
            files.append((name, status.getLen(), status.getModificationTime()))
        mark = hashlib.sha256(json.dumps([files, key, text, asdict(how)]).encode()).hexdigest()[:24]
        path = f"{folder}/fulltext-{mark}"
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")
        fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(done):
            fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)  # what an interrupted build left
            return cls.write(texts, key, text, path, how)
        return cls(spark, path, key)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """All postings, or those of some terms, which are pushed to the files."""
        df = self.spark.read.parquet(f"{self.path}/postings").drop("first")
        return df if terms is None else df.where(F.col("term").isin(terms)) if terms else df.limit(0)

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, inline: int = 2000) -> DataFrame:
        """(query_id, rank, key, score) of the k best texts by BM25; queries are (query_id, term). Equal scores (to 6 places) in order of key.

        Up to ``inline`` different terms are pushed to the files; more of them are joined with all postings.
        """
        if k < 1:
            raise ValueError("k is 1 at least")
        wanted = queries.select("query_id", "term").where("term is not null").distinct()
        terms = [r.term for r in wanted.select("term").distinct().limit(inline + 1).collect()]
        hits = self.postings(terms) if len(terms) <= inline else self.postings().join(wanted.select("term").distinct(), "term", "left_semi")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.lit(self.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(self.mean)))
        scored = hits.join(df, "term").select(self.key, "term", weight.alias("w")).join(wanted, "term")
        return best(scored.groupBy("query_id", self.key).agg(F.sum("w").alias("score")), self.key, k)

    def overlap(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, n): the k texts with the most different terms of a query."""
        wanted = queries.select("query_id", "term").where("term is not null").distinct()
        terms = [r.term for r in wanted.select("term").distinct().limit(2001).collect()]
        hits = self.postings(terms) if len(terms) <= 2000 else self.postings()
        n = hits.join(wanted, "term").groupBy("query_id", self.key).agg(F.count("*").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("n"), self.key)
        return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col(self.key).alias("id"), "n")


def best(scores: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", key, F.round("score", 6).alias("score"))


@dataclass(frozen=True)
class HashedWords:
    """A provider of embeddings without a model: words hashed to signed dimensions, damped by their count, of length 1.

    ``passage`` and ``query`` are put before texts of either kind, as models ask for;
    other providers have the same two methods.
    """

    dims: int = 64
    passage: str = ""
    query: str = ""

    def _place(self, word: str) -> tuple[int, int]:
        h = hashlib.md5(word.encode()).hexdigest()  # spread, not secrecy
        return int(h[:6], 16) % self.dims, 1 if int(h[6], 16) < 8 else -1

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        known: dict[str, tuple[int, int]] = {}
        for i, text in enumerate(texts):
            for word, n in Counter(words(text)).items():
                if word not in known:
                    known[word] = self._place(word)
                at, sign = known[word]
                out[i, at] += sign * (1 + math.log(n))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embedded(texts: DataFrame, key: str, text: str, provider: HashedWords = HashedWords(), kind: str = "passage", rows_at_once: int = 256) -> DataFrame:
    """(key, embedding) of texts; null texts have none, wordless ones are zero. A batch that does not fit into memory is halved until it does."""
    before = {"passage": provider.passage, "query": provider.query}[kind]

    def encode(some: list[str]) -> list[np.ndarray]:
        try:
            return [provider.encode(some)]
        except MemoryError:
            if len(some) < 2:
                raise
            return encode(some[: len(some) // 2]) + encode(some[len(some) // 2 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                x = np.concatenate(encode([before + t for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=[key, "embedding"])

    slim = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text"))
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, embedding array<double>")
