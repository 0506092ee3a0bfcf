"""Subject areas of documents from averaged word and subword embeddings.

A sentence is the average of its words, a word the average of its own embedding
and those of its character n-grams (hashed), and every subject has an independent
logistic output. A document's label says which subjects at least a share
``SHARE`` of its sentences deal with; so the loss compares the label with the
share of sentences the outputs accept, and learns the sentence model through it.

Training is synchronous: in every round each partition of the labelled sample
computes its gradient at the broadcast parameters, the gradients are summed and
one step is taken. The sample is bounded by ``SAMPLE`` labelled documents, chosen
by hash; scoring reads every document in one narrow pass.

Null and blank texts have no sentences and no subject. Of contradicting labels of
a document all count. Without any label no subject is given.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
SHARE = 0.25
BUCKETS = 1 << 14
DIM = 12
GRAMS = (3, 4, 5)
ROUNDS = 30
WARM_ROUNDS = 10
RATE = 0.2
#: every so manieth labelled document is held out, to choose the share of sentences from which a document has a subject
HELD_OUT = 5
#: that share where no held-out label says one
ACCEPT = 0.2
_STEPS = 100
#: partitions of the labelled sample; the sample is bounded, so this need not follow the cluster
PARTS = 6
SHARPNESS = 20.0

_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_LEAST_WORDS = 3


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence; headings and scraps of under three words are none."""
    out = []
    for s in _SENTENCE.split(text or ""):
        if s and not s.startswith("#"):
            ws = _WORD.findall(s.lower())
            if len(ws) >= _LEAST_WORDS:
                out.append(ws)
    return out


def features(word: str) -> list[int]:
    """The bucket of a word and those of its character n-grams."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)} if len(word) > 2 else set()
    return [zlib.crc32(marked.encode()) % BUCKETS] + [BUCKETS + zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


class Encoded:
    """Documents as flat arrays: words of sentences, sentences of documents, features of distinct words."""

    def __init__(self, texts: list[str | None], features_of: dict[str, list[int]] | None = None):
        self.vocabulary: dict[str, int] = {}
        put = self.vocabulary.setdefault
        words: list[int] = []
        starts, doc = [], []
        for i, text in enumerate(texts):
            for s in sentences(text):
                starts.append(len(words))
                doc.append(i)
                words += [put(w, len(self.vocabulary)) for w in s]
        self.words, self.starts, self.doc = np.array(words, np.int64), np.array(starts, np.int64), np.array(doc, np.int64)
        self.lengths = np.diff(np.append(self.starts, len(words))).astype(np.float32)
        self.docs = len(texts)
        self.counts = np.bincount(self.doc, minlength=self.docs).astype(np.float32)

    def word_features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, start of each word's, number of each word's)."""
        lists = [features(w) for w in self.vocabulary]
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.array([f for x in lists for f in x], np.int64), np.cumsum(sizes) - sizes, sizes


Params = tuple[np.ndarray, np.ndarray, np.ndarray]


def initial(outputs: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    return ((rng.standard_normal((2 * BUCKETS, DIM)) * 0.1).astype(np.float32), (rng.standard_normal((DIM, outputs)) * 0.1).astype(np.float32), np.full(outputs, -1.0, np.float32))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shares(logits: np.ndarray, coded: Encoded) -> np.ndarray:
    """The share of each document's sentences that each output accepts, softly."""
    out = np.zeros((coded.docs, logits.shape[1]), np.float32)
    q = _sigmoid(logits)
    for k in range(logits.shape[1]):
        out[:, k] = np.bincount(coded.doc, q[:, k], coded.docs) / np.maximum(coded.counts, 1)
    return out


def gradient(params: Params, coded: Encoded, labels: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], sharpness: float = SHARPNESS, warm: bool = False) -> tuple[Params, float]:
    """Summed gradient of the logistic loss of the shares, and the loss; ``warm``: of each sentence by itself, with its document's label."""
    table, outputs, bias = params
    flat, first, sizes = lists
    if not len(coded.words):
        return (np.zeros_like(table), np.zeros_like(outputs), np.zeros_like(bias)), 0.0
    words = np.add.reduceat(table[flat], first) / sizes[:, None].astype(np.float32)
    hidden = np.add.reduceat(words[coded.words], coded.starts) / coded.lengths[:, None]
    q = _sigmoid(hidden @ outputs + bias)
    share = np.stack([np.bincount(coded.doc, q[:, k], coded.docs) for k in range(q.shape[1])], 1) / np.maximum(coded.counts, 1)[:, None]
    p = _sigmoid(sharpness * (share - SHARE))
    seen = coded.counts > 0
    loss = float(-(np.log(np.where(labels > 0, p, 1 - p) + 1e-9))[seen].sum())
    dshare = (p - labels) * sharpness / np.maximum(coded.counts, 1)[:, None]
    dz = ((q - labels[coded.doc]) / np.maximum(coded.counts, 1)[coded.doc, None] if warm else dshare[coded.doc] * q * (1 - q)).astype(np.float32)
    dhidden = (dz @ outputs.T) / coded.lengths[:, None]
    per_word = np.repeat(dhidden, coded.lengths.astype(np.int64), axis=0)
    dtable = np.zeros_like(table)
    for k in range(table.shape[1]):
        g = np.bincount(coded.words, per_word[:, k], len(sizes)) / sizes
        dtable[:, k] = np.bincount(flat, np.repeat(g, sizes), len(table))
    return (dtable, hidden.T @ dz, dz.sum(0)), loss


class Adam:
    def __init__(self, params: Params, rate: float = RATE):
        self.params, self.rate, self.round = params, rate, 0
        self.first, self.second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: Params, scale: float) -> Params:
        self.round += 1
        out = []
        for k, (p, g) in enumerate(zip(self.params, grads, strict=True)):
            g = g * scale
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            move = self.first[k] / (1 - 0.9**self.round) / (np.sqrt(self.second[k] / (1 - 0.99**self.round)) + 1e-8)
            out.append((p - self.rate * move).astype(np.float32))
        self.params = tuple(out)
        return self.params


def _encode(subjects: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        if texts:
            coded = Encoded(texts)
            lists = coded.word_features()
            coded.vocabulary = {}
            y = np.array([[s in given for s in subjects] for given in map(set, labels)], np.float32)
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps((coded, lists, y), 5)], pa.binary())})

    return encode


def _differentiate(shared, warm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                coded, lists, y = pickle.loads(part)
                grads, loss = gradient(shared.value, coded, y, lists, warm=warm)
                yield pa.RecordBatch.from_pydict({"grads": pa.array([pickle.dumps(grads, 5)], pa.binary()), "loss": pa.array([loss]), "docs": pa.array([float(len(y))])})

    return run


def _tallied(shared):
    """(step, tp, fp) of each step of the share: labels held out that a document's share of that step would meet or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, outputs, bias = shared.value
        for b in batches:
            for part in b.column(0).to_pylist():
                coded, (flat, first, sizes), y = pickle.loads(part)
                if not len(coded.words):
                    continue
                words = np.add.reduceat(table[flat], first) / sizes[:, None].astype(np.float32)
                z = np.add.reduceat(words[coded.words], coded.starts) / coded.lengths[:, None] @ outputs + bias
                step = np.minimum((shares(z, coded) * _STEPS).astype(np.int64), _STEPS)[coded.counts > 0]
                y = y[coded.counts > 0] > 0
                tp, fp = np.bincount(step[y], minlength=_STEPS + 1), np.bincount(step[~y], minlength=_STEPS + 1)
                yield pa.RecordBatch.from_pydict({"step": pa.array(range(_STEPS + 1), pa.int32()), "tp": pa.array(tp, pa.int64()), "fp": pa.array(fp, pa.int64())})

    return run


def best_share(tp: np.ndarray, fp: np.ndarray) -> float:
    """The share with the best F1, given the labels met and not met by step; the middle of the steps that are within 0.001 of the best."""
    if not tp.sum():
        return ACCEPT
    met, missed = np.cumsum(tp[::-1])[::-1], np.cumsum(fp[::-1])[::-1]
    f1 = 2 * met / np.maximum(met + missed + tp.sum(), 1)
    best = np.nonzero(f1 >= f1.max() - 0.001)[0]
    return max(float(best[len(best) // 2]), 1.0) / _STEPS


def train(corpus: DataFrame, labels: DataFrame, subjects: list[str], sample: int = SAMPLE, rounds: int = ROUNDS, warm: int = WARM_ROUNDS) -> tuple[Params, float]:
    """(parameters, share from which a subject is accepted), fitted on at most ``sample`` labelled documents.

    Gradients are summed over partitions in every round; one document in HELD_OUT is
    kept out of them, and the share is the one with the best F1 on these.
    """
    spark = corpus.sparkSession
    given = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("given"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by ``sample`` rows, so it is sent to the documents and not they to it.
    chosen = corpus.where("text is not null").select("doc_id", "text").join(F.broadcast(given), "doc_id")
    out = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    coded = chosen.withColumn("out", out).repartition(PARTS, "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    parts = coded.where("not out").select("text", "given").mapInArrow(_encode(subjects), "part binary").persist(StorageLevel.MEMORY_AND_DISK)
    adam = Adam(initial(len(subjects)))
    try:
        for r in range(rounds):
            shared = spark.sparkContext.broadcast(adam.params)
            total, docs = None, 0.0
            for row in parts.mapInArrow(_differentiate(shared, r < warm), "grads binary, loss double, docs double").collect():
                grads = pickle.loads(row.grads)
                total = grads if total is None else tuple(a + g for a, g in zip(total, grads, strict=True))
                docs += row.docs
            shared.destroy()
            if not docs:
                break
            adam.step(total, 1 / docs)
        shared = spark.sparkContext.broadcast(adam.params)
        tally = coded.where("out").select("text", "given").mapInArrow(_encode(subjects), "part binary").mapInArrow(_tallied(shared), "step int, tp bigint, fp bigint")
        tp, fp = np.zeros(_STEPS + 1, np.int64), np.zeros(_STEPS + 1, np.int64)
        for row in tally.groupBy("step").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).collect():
            tp[row.step], fp[row.step] = row.tp, row.fp
        shared.destroy()
    finally:
        parts.unpersist()
        coded.unpersist()
    return adam.params, best_share(tp, fp)


def _score(shared, subjects: list[str], accept: float, rows_at_once: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, outputs, bias = shared.value
        logit: dict[str, int] = {}
        known = np.zeros((0, len(subjects)), np.float32)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                coded = Encoded(b.column(1).to_pylist())
                if not len(coded.words):
                    continue
                if len(logit) > 400_000:  # names are endless; what is kept is only a cache
                    logit, known = {}, known[:0]
                fresh = [w for w in coded.vocabulary if w not in logit]
                if fresh:
                    lists = [features(w) for w in fresh]
                    sizes = np.array([len(x) for x in lists])
                    emb = np.add.reduceat(table[np.array([f for x in lists for f in x])], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)
                    for w in fresh:
                        logit[w] = len(logit)
                    known = np.concatenate((known, (emb @ outputs).astype(np.float32)))
                per_word = known[np.array([logit[w] for w in coded.vocabulary])]
                z = np.add.reduceat(per_word[coded.words], coded.starts) / coded.lengths[:, None] + bias
                share = shares(z, coded)
                doc, subject = np.nonzero(share >= accept)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(doc)), "subject": pa.array([subjects[k] for k in subject.tolist()], pa.string()), "share": pa.array(share[doc, subject].astype(np.float64))})

    return run


def assign(corpus: DataFrame, labels: DataFrame, subjects_table: DataFrame, accept: float | None = None, **training) -> DataFrame:
    """(doc_id, subject, share): a row for each subject that about a quarter of a document's sentences deal with.

    ``subjects_table`` is the list of subjects, a fixed small table; its names are
    the outputs of the model and are read by the driver. ``accept`` is the share of
    sentences from which a document has a subject; by default it is chosen in training.
    """
    subjects = sorted({r.subject for r in subjects_table.select("subject").where("subject is not null").distinct().collect()})
    params, share = train(corpus, labels, subjects, **training)
    shared = corpus.sparkSession.sparkContext.broadcast(params)
    return corpus.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score(shared, subjects, share if accept is None else accept), "doc_id bigint, subject string, share double")
