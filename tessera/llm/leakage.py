"""Held-out passages that stand, wholly or partly, in a corpus.

Generalised suffix automata over the normalised words of the passages are built
on the driver, one for every ``BLOCK_WORDS`` words of passages, kept as plain
arrays and broadcast; the corpus is read once for every ``SCAN_BYTES`` of automata.
Corpus words stream through them in a narrow pass: no shuffle, nothing gathered.

Before an automaton, stretches are cut out in which every pair of neighbours is
a pair of neighbours of some passage; outside them no match can be as long as
asked, so nothing is lost and few words are stepped in Python.

Null and blank texts hold nothing. A passage shorter than the limit cannot leak.
Documents and items without a key are left out.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import word_spans, words

LEAST = 13
#: words of passages in one automaton, which bounds what building it takes on the driver (about 200 MB), and bytes of automata a scan holds in every worker
BLOCK_WORDS, SCAN_BYTES = 200_000, 200 << 20


class _Growing:
    """A generalised suffix automaton while it is built: length, link and transitions of each state."""

    def __init__(self, texts: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if (there := nxt[last].get(word)) is not None:
            return there if length[there] == length[last] + 1 else self._clone(last, there, word)
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        while last >= 0 and word not in nxt[last]:
            nxt[last][word] = state
            last = link[last]
        if last >= 0:
            there = nxt[last][word]
            link[state] = there if length[there] == length[last] + 1 else self._clone(last, there, word)
        return state

    def _clone(self, last: int, there: int, word: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(self.link[there])
        self.next.append(dict(self.next[there]))
        self.link[there] = copy
        while last >= 0 and self.next[last].get(word) == there:
            self.next[last][word] = copy
            last = self.link[last]
        return copy


class Automaton:
    """A generalised suffix automaton over integer words of many texts, as sorted arrays."""

    def __init__(self, passages: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.ids: dict[str, int] = {}
        texts = [(item, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for item, ws in passages if len(ws) >= least]
        grown = _Growing([t for _, t in texts])
        length, link = grown.length, grown.link
        #: the state that holds the last ``least`` words of a state's words: up the links while they are as long
        base = array("i", [0]) * len(length)
        for state in sorted(range(1, len(length)), key=length.__getitem__):
            base[state] = base[link[state]] if length[link[state]] >= least else state
        holders: dict[int, set[int]] = {}
        for item, text in texts:
            state = 0
            for place, word in enumerate(text):
                state = grown.next[state][word]
                if place + 1 >= least:
                    holders.setdefault(base[state], set()).add(item)
        # A match of at least ``least`` words is held by every item that holds its last ``least`` words.
        self.items = {state: tuple(sorted(held)) for state, held in holders.items()}
        self.base, self.length, self.link = base, array("i", length), array("i", link)
        self.words = max(len(self.ids), 1)
        steps = sorted((state * self.words + word, there) for state, out in enumerate(grown.next) for word, there in out.items())
        self.keys, self.targets = array("q", [k for k, _ in steps]), array("i", [t for _, t in steps])
        pairs = {a * self.words + b for _, text in texts for a, b in zip(text, text[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def nbytes(self) -> int:
        """About the memory it takes."""
        arrays = sum(a.itemsize * len(a) for a in (self.base, self.length, self.link, self.keys, self.targets))
        return arrays + self.pairs.nbytes + 150 * len(self.ids) + 150 * len(self.items)

    def _step(self, state: int, word: int) -> int:
        """The state after a word, or -1."""
        key = state * self.words + word
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def matches(self, text: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place of the last word, longest matching length, state) wherever that length is enough."""
        state = matched = 0
        for place, word in enumerate(text):
            there = self._step(state, word)
            while there < 0 and state:
                state = self.link[state]
                matched = self.length[state]
                there = self._step(state, word)
            state, matched = (there, matched + 1) if there >= 0 else (0, 0)
            if matched >= self.least:
                yield place, matched, state

    def held(self, state: int) -> tuple[int, ...]:
        """The items of a matched state."""
        return self.items.get(self.base[state], ())

    def stretches(self, texts: list[list[str]]) -> Iterator[tuple[int, int, list[int]]]:
        """(text, place of its first word, words) of every stretch that may hold a match."""
        get, breaks = self.ids.get, [-1]
        flat = np.fromiter((get(w, -1) for ws in texts for part in (ws, breaks) for w in part), np.int64)
        if not len(flat) or not len(self.pairs):
            return
        known = (flat[:-1] >= 0) & (flat[1:] >= 0)
        at = np.nonzero(known)[0]
        keys = flat[at] * self.words + flat[at + 1]
        found = np.searchsorted(self.pairs, keys)
        at = at[self.pairs[np.minimum(found, len(self.pairs) - 1)] == keys]
        if not len(at):
            return
        cuts = np.nonzero(np.diff(at) > 1)[0]
        first, last = at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))] + 1
        ends = np.cumsum([len(ws) + 1 for ws in texts])
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a + 1 >= self.least:
                text = int(np.searchsorted(ends, a, "right"))
                begin = int(ends[text - 1]) if text else 0
                yield text, a - begin, flat[a : b + 1].tolist()


def _blocks(items: DataFrame, key: str, text: str, least: int, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Passages in blocks of a bounded number of words, streamed to the driver."""
    block, size = [], 0
    for row in items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint"), text).toLocalIterator():
        ws = words(row[1])
        if len(ws) < least:
            continue
        if block and size + len(ws) > most:
            yield block
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    yield block


def _scans(items: DataFrame, item_key: str, passage: str, least: int, most: int, scan_bytes: int) -> Iterator[list]:
    """Broadcast automata of all passages, in lists of a bounded size."""
    spark = items.sparkSession
    held, size = [], 0
    for block in _blocks(items, item_key, passage, least, most):
        automaton = Automaton(block, least)
        if held and size + automaton.nbytes() > scan_bytes:
            yield held
            held, size = [], 0
        held.append(spark.sparkContext.broadcast(automaton))
        size += automaton.nbytes()
    yield held


def _texts(corpus: DataFrame, key: str, text: str) -> DataFrame:
    return corpus.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def _found(shared: list):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, texts, hits = b.column(0).to_pylist(), [words(t) for t in b.column(1).to_pylist()], set()
            for automaton in (s.value for s in shared):
                for text, _, stretch in automaton.stretches(texts):
                    for _, _, state in automaton.matches(stretch):
                        hits.update((docs[text], item) for item in automaton.held(state))
            ordered = sorted(hits)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([h[0] for h in ordered], pa.int64()), "item_id": pa.array([h[1] for h in ordered], pa.int64())})

    return scan


def leaked(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", least: int = LEAST, most: int = BLOCK_WORDS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc_id, item_id) of every document that holds ``least`` consecutive words of an item's passage."""
    out, scans, slim = None, 0, _texts(corpus, key, text)
    for shared in _scans(items, item_key, passage, least, most, scan_bytes):
        part = slim.mapInArrow(_found(shared), "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
        scans += 1
    # An item whose passages (of a repeated key) stand in two scans may be found by both.
    return out.distinct() if scans > 1 else out


def _merged(ranges: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """Half-open ranges in order, those that overlap (or are ``gap`` apart) joined."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _spans(shared: list):
    """(doc_id, mark of the text, text, spans): the affected texts with the ranges of characters that matches cover."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, marks, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            split, ranges = [words(t) for t in texts], {}
            for automaton in (s.value for s in shared):
                for text, start, stretch in automaton.stretches(split):
                    for place, matched, _ in automaton.matches(stretch):
                        ranges.setdefault(text, []).append((start + place - matched + 1, start + place + 1))
            rows = []
            for text in sorted(ranges):
                places = word_spans(texts[text])
                rows.append((docs[text], marks[text], texts[text], [(places[a][1], places[z - 1][2]) for a, z in _merged(ranges[text])]))
            spans = pa.array([[{"a": a, "z": z} for a, z in r[3]] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), spans], names=["doc_id", "mark", "text", "spans"])

    return scan


def cleaned(corpus: DataFrame, items: DataFrame, coverage: float = 0.5, least: int = LEAST, most: int = BLOCK_WORDS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc_id, spans, removed_chars, dropped, text): affected documents without the leaked ranges; one leaked beyond ``coverage`` of its characters is dropped (text null).

    Every scan gives the ranges it found; the ranges of a text are joined, whichever
    scan they come from, before it is cut once. Only affected texts are shuffled.
    Texts of a repeated doc_id are cut by their own ranges; equal rows give one.
    """
    marked = _texts(corpus, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = None
    for shared in _scans(items, "item_id", "passage", least, most, scan_bytes):
        part = marked.mapInArrow(_spans(shared), "doc_id bigint, mark bigint, text string, spans array<struct<a: int, z: int>>")
        found = part if found is None else found.unionByName(part)
    ranges = found.groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("r"))
    merged = F.expr("""aggregate(r, cast(array() as array<struct<a: int, z: int>>), (acc, x) -> if(size(acc) > 0 and x.a <= element_at(acc, -1).z,
        array_append(slice(acc, 1, size(acc) - 1), named_struct('a', element_at(acc, -1).a, 'z', greatest(element_at(acc, -1).z, x.z))), array_append(acc, x)))""")
    cut = ranges.select("doc_id", "text", merged.alias("r"))
    removed = F.aggregate("r", F.lit(0).cast("bigint"), lambda acc, x: acc + x["z"] - x["a"])
    gone = cut.withColumn("removed_chars", removed).withColumn("dropped", F.col("removed_chars") > F.lit(coverage) * F.length("text"))
    # Between the ranges: from the end of one to the beginning of the next.
    kept = F.expr("concat_ws('', transform(sequence(0, size(r)), i -> substring(text, if(i = 0, 1, r[i - 1].z + 1), if(i = size(r), length(text), r[i].a) - if(i = 0, 0, r[i - 1].z))))")
    return gone.select("doc_id", F.size("r").alias("spans"), "removed_chars", "dropped", F.when(~F.col("dropped"), kept).alias("text"))
