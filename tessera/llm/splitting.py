"""Oversized texts cut into pieces at natural boundaries, with overlap.

A text is tokenised once for all configurations. Where a cut has to fall is
content-defined: the landmark is the place with the least rolling hash of its
last ``HASHED`` tokens between the smallest and largest size of a piece; it snaps
to the nearest natural boundary of the best kind there is in that range (section,
paragraph, line or sentence, word). Places depend only on the text nearby, so an
edit alters the pieces around it and the cuts beyond fall where they fell.

Neighbours share ``overlap_tokens`` tokens, or up to a word more where that many
would begin within a word. ``section_aware`` texts are cut at every heading first
and share nothing across it. A piece is a half-open range of characters; its
``tokens`` never exceed the window.

A piece that begins or ends within a word is counted by itself as well, and made
smaller where that is more than the window.

Null, blank and short texts give no rows. A stretch without any boundary is cut
between characters. A configuration without a positive window, or whose overlap
leaves no room, raises an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens as T
from tessera.operators.documents import SECTIONS as FILING_SECTIONS

HASHED = 8
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = 4, 3, 2, 1, 0
KINDS = {SECTION: "section", PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", CHARACTER: "character", 5: "end"}
_TITLE = r"(?:#{1,6}[ \t]+\S[^\n\r]*|(?:item|part)[ \t]+[0-9ivx]+[a-c]?\b[.:]?[^\n\r]{0,80})"
_HEADING = re.compile(rf"(?:\A|(?<=[\n\r])){_TITLE}(?=[\n\r]|\Z)", re.I)
#: the same for texts whose lines all end in a line feed, where the search skips from line to line
_HEADING_LF = re.compile(rf"^{_TITLE}$", re.I | re.M)
# Code points that end sentences, close quotations and are blank.
_ENDS, _CLOSERS, _BLANKS = (0x2E, 0x21, 0x3F, 0x3002, 0xFF01, 0xFF1F, 0x2026), (0x22, 0x27, 0x29, 0x5D, 0x201D, 0x2019), (0x20, 0x09, 0x0A, 0x0D, 0xA0, 0x3000)
SCHEMA = "source_table string, record_key string, config_id string, piece int, char_start int, char_end int, tokens int, boundary string, text string"

@dataclass(frozen=True)
class Config:
    config_id: str
    window: int
    overlap: int
    section_aware: bool

    def __post_init__(self):
        if self.window < 1 or not 0 <= self.overlap < self.window:
            raise ValueError(f"{self.config_id}: a window of {self.window} with an overlap of {self.overlap} leaves no room")


def _among(codes: np.ndarray, values: tuple[int, ...]) -> np.ndarray:
    out = codes == values[0]
    for v in values[1:]:
        if v < 256 or codes.itemsize > 1:
            out |= codes == v
    return out


def _after_blank(text: str, places: np.ndarray) -> np.ndarray:
    """Which places are after a blank character."""
    codes = _codes(text)
    if not len(codes):
        return np.ones(len(places), bool)
    return (places > 0) & _among(codes[np.maximum(places - 1, 0)], _BLANKS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _breaks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters at which sentences (or lines) and paragraphs break: the blank after a sentence, the character after a line end."""
    codes = _codes(text)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank, end = _among(codes, _BLANKS), _among(codes, _ENDS)
    ended = blank[1:] & end[:-1]
    ended[1:] |= blank[2:] & _among(codes[1:-1], _CLOSERS) & end[:-2]
    sentences = np.nonzero(ended)[0] + 1
    line = (codes == 10) | (codes == 13)
    after = np.nonzero(line[:-1] & ~line[1:])[0] + 1
    if not len(after):
        return sentences, after
    feeds = np.concatenate(([0], np.cumsum(codes == (10 if "\n" in text else 13))))
    solid = np.nonzero(~blank)[0]
    before = np.searchsorted(solid, after)  # solid characters before the break
    begins = np.where(before > 0, solid[np.maximum(before - 1, 0)] + 1, 0) if len(solid) else np.zeros(len(after), np.int64)
    two = feeds[after] - feeds[begins] > 1
    return np.concatenate((sentences, after[~two])), after[two]


class Tokenised:
    """A text with its token ends (in characters), natural boundaries and landmarks (as token places)."""

    def __init__(self, text: str, path: str = T.VOCABULARY):
        self.text, self.path = text, path
        ids = np.asarray(T.ids(text, path), np.int64)
        self.count = len(ids)
        byte_ends = T.byte_ends(ids, path)
        starts = T.char_starts(text)
        if starts is None:
            self.ends, aligned = byte_ends, None
        else:
            at = np.searchsorted(starts, byte_ends)
            aligned = starts[np.minimum(at, len(starts) - 1)] == byte_ends
            self.ends = np.where(aligned, at, np.maximum(at - 1, 0))
        #: place k is before token k
        self.places = np.concatenate(([0], self.ends))
        self.clean = np.ones(self.count + 1, bool) if aligned is None else np.concatenate(([True], aligned))
        words = np.ones(self.count + 1, bool)
        words[: self.count] = T.word_starts(path)[ids]
        self.words = words & self.clean
        #: places that divide no word: before a blank, after one, and the ends
        whole = self.words.copy()
        whole[self.clean & _after_blank(text, self.places)] = True
        whole[0] = True
        self.whole = whole.tolist()
        heads = [m.start() for m in (_HEADING if "\r" in text else _HEADING_LF).finditer(text)]
        self.sections = self._at(np.array(heads, np.int64))
        kinds = np.zeros(self.count + 1, np.int8)
        sentences, paragraphs = _breaks(text)
        kinds[self._at(sentences)] = SENTENCE
        kinds[self._at(paragraphs)] = PARAGRAPH
        kinds[self.sections] = SECTION
        self.natural = np.nonzero(kinds)[0]
        self.kinds = kinds[self.natural]
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        rolled = sums[HASHED:] - sums[:-HASHED] if self.count >= HASHED else np.zeros(0, np.uint64)
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
        self.hash = np.concatenate((np.full(self.count + 1 - len(rolled), np.iinfo(np.uint64).max, np.uint64), rolled))

    def _at(self, chars: np.ndarray) -> np.ndarray:
        """Token places of character positions; a position within a token is left out."""
        if not len(chars):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.places, chars), self.count)
        return k[(self.places[k] == chars) & self.clean[k] & (k > 0)]


def _cut(t: Tokenised, least: int, most: int) -> tuple[int, int]:
    """The place of a cut in [least, most], and its kind."""
    landmark = least + int(np.argmin(t.hash[least : most + 1]))
    lo, hi = np.searchsorted(t.natural, least), np.searchsorted(t.natural, most, "right")
    if lo < hi:
        kinds = t.kinds[lo:hi]
        best = int(kinds.max())
        there = t.natural[lo:hi][kinds == best]
        return int(there[np.argmin(np.abs(there - landmark))]), best
    for flags, kind in ((t.words, WORD), (t.clean, CHARACTER)):
        there = np.nonzero(flags[least : most + 1])[0] + least
        if len(there):
            return int(there[np.argmin(np.abs(there - landmark))]), kind
    return most, CHARACTER


def _alone(t: Tokenised, start: int, end: int) -> int:
    """Tokens of a piece by itself: those within the text, but where it begins or ends within a word it is counted anew."""
    if t.whole[start] and t.whole[end]:
        return end - start
    return T.count(t.text[t.places[start] : t.places[end]], t.path)


def _stretch(t: Tokenised, begin: int, end: int, config: Config) -> Iterator[tuple[int, int, int]]:
    """(first token, end token, kind of the cut) of the pieces of a stretch of tokens."""
    start = fresh = begin
    while True:
        if end - start <= config.window and _alone(t, start, end) <= config.window:
            yield start, end, 5
            return
        most = min(start + config.window, end)
        while True:
            least = min(max(fresh + 1, start + config.window // 2), most)
            cut, kind = _cut(t, least, most)
            beyond = _alone(t, start, cut) - config.window
            if beyond <= 0 or cut - 1 <= max(fresh, start):
                break
            most = max(cut - max(beyond, 1), max(fresh, start) + 1)
        yield start, cut, kind
        fresh, back = cut, cut - config.overlap
        if config.overlap:
            # Back to the beginning of a word, but for fewer tokens than would eat up the next piece.
            floor = max(start + 1, back - min(8, config.window - config.overlap - 1))
            there = next((k for k in range(back, floor - 1, -1) if t.words[k]), None)
            if there is None:
                there = next((k for k in range(back, start, -1) if t.clean[k]), cut)
            back = there
        start = back


def pieces(t: Tokenised, config: Config) -> Iterator[tuple[int, int, int]]:
    if not config.section_aware:
        yield from _stretch(t, 0, t.count, config)
        return
    bounds = sorted({0, t.count, *t.sections.tolist()})
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield from ((s, e, SECTION if k == 5 and e < t.count else k) for s, e, k in _stretch(t, a, b, config))


def _split(configs: list[Config], path: str, with_text: bool):
    smallest = min(c.window for c in configs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        names = ("source_table", "record_key", "config_id", "piece", "char_start", "char_end", "tokens", "boundary", "text")
        for b in batches:
            out: list[list] = [[] for _ in names]
            for source, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if len(text) <= smallest and len(text.encode("utf-8", "replace")) <= smallest:
                    continue  # a token has a byte at least
                t = Tokenised(text, path)
                places = t.places.tolist() if t.count > smallest else ()
                for c in configs:
                    if t.count > c.window:
                        for n, (s, e, kind) in enumerate(pieces(t, c)):
                            for column, value in zip(out, (source, key, c.config_id, n, places[s], places[e], e - s, KINDS[kind], text[places[s] : places[e]] if with_text else None), strict=True):
                                column.append(value)
                if len(out[0]) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, types, strict=True)], names=list(names))
                    out = [[] for _ in names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, types, strict=True)], names=list(names))

    return run


def filing_bodies(edgar: DataFrame) -> DataFrame:
    """(record_key, text): the non-blank sections of a filing under their headings; line ends made plain."""
    parts = [F.when(F.trim(F.regexp_replace(f"section_{s}", r"\s+", " ")) != "", F.concat(F.lit(f"## Item {s.upper()}\n\n"), F.regexp_replace(f"section_{s}", r"\r\n?", "\n"))) for s in FILING_SECTIONS]
    return edgar.select(F.col("filename").alias("record_key"), F.concat_ws("\n\n", *parts).alias("text"))


def read_configs(configs: DataFrame) -> list[Config]:
    """The rows of a configuration table: a small fixed table, read by the driver."""
    rows = configs.select("config_id", "window_size_tokens", "overlap_tokens", "split_mode").orderBy("config_id").collect()
    return [Config(r[0], int(r[1]), int(r[2] or 0), r[3] == "section_aware") for r in rows]


def split(sources: list[tuple[str, DataFrame]], configs: list[Config], path: str = T.VOCABULARY, with_text: bool = True) -> DataFrame:
    """Pieces of all texts longer than a configuration's window; sources: (name, (record_key, text))."""
    texts = None
    for name, df in sources:
        part = df.where(F.col("text").isNotNull()).select(F.lit(name).alias("source_table"), F.col("record_key").cast("string").alias("record_key"), "text")
        texts = part if texts is None else texts.unionByName(part)
    return texts.mapInArrow(_split(configs, path, with_text), SCHEMA)
