"""Near-duplicate records: all pairs of a similarity, without comparing all pairs.

A record is its set of word shingles. Its sketch has ``POSITIONS`` minhash values;
two records agree in a position with the probability of their similarity, so a
pair of at least the similarity differs in no more than ``distance_bound`` of L
positions, but for a chance of ``MISS``. Candidates are all pairs within that
Hamming bound, found by the generalised pigeonhole principle:

* positions whose agreement is correlated (measured on pairs of a sample) are
  grouped into parts;
* part i gets a threshold t_i from -1 (left out) to its width less one, such that
  the sum of t_i + 1 is the bound plus one; a pair within the bound then differs
  in at most t_i positions of some part i. Of all such thresholds dynamic
  programming takes the cheapest by probes written and estimated candidates;
* a part is probed by its values without t_i of its positions, all choices of them.

Pairs that meet are compared at once by one bit of each position, against a Hamming
bound missed with a chance of ``MISS`` as well; what is left is verified exactly on
the whole sets. A pair of exactly the similarity is lost with a chance of 1e-5 at
most in all, a more similar one far more rarely.

Copies of one set are reduced to one before probes are joined. Probes and groups
of copies that many records share are counted and joined block by block, so that
no task holds such a group.

Records of fewer than ``least_words`` words, or without a key, are left out; null
texts count as empty. Sets are told apart by a 64-bit hash. The least similarity is 0.05.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import sampling
from tessera.session import with_checkpoints

WORDS, LEAST_WORDS = 5, 30
POSITIONS, SAMPLE = 256, 2000
#: two bounds are each missed with this chance at most
MISS = 1e-5 / 2
#: numbers of positions and widths of a part that are considered; the later ones only where the earlier cannot hold the bound
PLANS = (((64, 4), (96, 4), (80, 8)), ((128, 4), (256, 4)))
#: estimated cost of comparing a pair that meets, in probes written
PAIR_COST = 0.1
#: more members than this and a probe or group of copies is joined in blocks; so many such groups at most are told to all tasks
HOT, MOST_HOT = 4096, 1_000_000
#: keys of records to be verified that are sent to all tasks at most
MOST_WANTED = 500_000


def distance_bound(places: int, differ: float, miss: float = MISS) -> int:
    """The least d such that more than d of ``places`` independent places differ with a chance of at most ``miss``."""
    if differ <= 0:
        return 0
    tail, d = 0.0, places
    while d >= 0:
        tail += np.exp(lgamma(places + 1) - lgamma(d + 1) - lgamma(places - d + 1) + d * log(differ) + (places - d) * log1p(-differ))
        if tail > miss:
            return d
        d -= 1
    return 0


def allocate(costs: list[list[float]], goal: int) -> list[int] | None:
    """Thresholds t of each part with the least total of costs[part][t + 1] whose sum of t + 1 is ``goal``; None if there are none."""
    least = np.full(goal + 1, np.inf)
    least[0] = 0.0
    choice = np.zeros((len(costs), goal + 1), np.int64)
    for part, cost in enumerate(costs):
        reached = np.full(goal + 1, np.inf)
        for units, c in enumerate(cost):
            if units > goal:
                break
            through = np.full(goal + 1, np.inf)
            through[units:] = least[: goal + 1 - units] + c
            better = through < reached
            reached[better], choice[part, better] = through[better], units
        least = reached
    if not np.isfinite(least[goal]):
        return None
    out, left = [], goal
    for part in range(len(costs) - 1, -1, -1):
        out.append(int(choice[part, left]) - 1)
        left -= int(choice[part, left])
    return out[::-1]


def correlated_parts(sketches: np.ndarray, positions: int, width: int, pairs: int = 100_000) -> list[list[int]]:
    """Positions grouped by how strongly their agreement is correlated over pairs of sampled sketches."""
    n = len(sketches)
    if n < 2:
        return [list(range(i, i + width)) for i in range(0, positions, width)]
    rng = np.random.default_rng(11)
    a = rng.integers(0, n, pairs)
    b = (a + rng.integers(1, n, pairs)) % n
    agree = (sketches[a, :positions] == sketches[b, :positions]).astype(np.float32)
    agree -= agree.mean(0)
    spread = np.sqrt((agree**2).mean(0)) + 1e-9
    correlation = (agree.T @ agree) / pairs / spread[:, None] / spread[None, :]
    np.fill_diagonal(correlation, -np.inf)
    free, out = set(range(positions)), []
    while free:
        left = np.array(sorted(free))
        within = correlation[np.ix_(left, left)]
        first = left[int(np.argmax(within.max(1)))] if len(left) > 1 else left[0]
        part = [int(first)]
        free.discard(int(first))
        while len(part) < width:
            left = np.array(sorted(free))
            nearest = int(left[int(np.argmax(correlation[np.ix_(part, left)].sum(0)))])
            part.append(nearest)
            free.discard(nearest)
        out.append(sorted(part))
    return out


def _meeting(values: np.ndarray) -> float:
    """How many pairs of rows are equal."""
    packed = np.ascontiguousarray(values).view(np.dtype((np.void, values.dtype.itemsize * values.shape[1]))).ravel()
    sizes = np.unique(packed, return_counts=True)[1]
    return float((sizes * (sizes - 1) / 2).sum())


Plan = tuple[list[list[int]], list[int]]


def planned(sketches: np.ndarray, count: int, similarity: float) -> Plan:
    """(parts, thresholds) of least estimated cost for ``count`` records like the sampled ``sketches``."""
    scale = (count / max(len(sketches), 2)) ** 2
    for choices in PLANS:
        best: tuple[float, Plan] | None = None
        for positions, width in choices:
            goal = distance_bound(positions, 1 - similarity) + 1
            if goal > positions:
                continue
            parts, costs = correlated_parts(sketches, positions, width), []
            for part in parts:
                cost = [0.0]
                for t in range(width):
                    # Narrow keys first: where few positions are kept, every choice of them is counted.
                    kept = list(combinations(part, width - t))
                    met = sum(_meeting(sketches[:, list(k)]) for k in kept) if len(sketches) > 1 else 0.0
                    cost.append(len(kept) * count + PAIR_COST * met * scale)
                costs.append(cost)
            thresholds = allocate(costs, goal)
            if thresholds is None:
                continue
            total = sum(c[t + 1] for c, t in zip(costs, thresholds, strict=True))
            if best is None or total < best[0]:
                best = (total, (parts, thresholds))
        if best:
            return best[1]
    raise ValueError(f"a similarity of {similarity} is too low for {POSITIONS} positions")


def _hashes(n: int):
    odd = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * odd[1]
        x = (x ^ (x >> np.uint64(27))) * odd[2]
        return x ^ (x >> np.uint64(31))

    def shingles(words: np.ndarray) -> np.ndarray:
        """Distinct hashes of the runs of n words, sorted as signed numbers: words are hashes themselves, each place has its own odd factor."""
        total = words[: len(words) - n + 1] * odd[0]
        for i in range(1, n):
            # Beyond the factors there are, places are told apart by mixing what came before.
            total = (mix(total) if i % len(odd) == 0 else total) + words[i : len(words) - n + 1 + i] * odd[i % len(odd)]
        return np.unique(mix(total).view(np.int64))

    return shingles


_WORD = re.compile(r"[a-z0-9]+")


class Shingler:
    """Shingle sets of texts and their minhash sketches; words are hashed once a worker."""

    def __init__(self, words: int, least_words: int, positions: int = POSITIONS):
        self.least, self.shingles, self.known = max(least_words, words), _hashes(words), {}
        rng = np.random.default_rng(20240229)
        self.odd = rng.integers(1, 1 << 31, positions, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(1, 1 << 31, positions, dtype=np.uint32)

    def set_of(self, text: str | None) -> np.ndarray | None:
        words = _WORD.findall((text or "").lower())
        if len(words) < self.least:
            return None
        if len(self.known) > 500_000:  # only a cache
            self.known = {}
        try:
            codes = list(map(self.known.__getitem__, words))
        except KeyError:
            for w in set(words):
                if w not in self.known:
                    self.known[w] = xxhash.xxh3_64_intdigest(w)
            codes = list(map(self.known.__getitem__, words))
        return self.shingles(np.array(codes, np.uint64))

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """The least value of each (32-bit) hash function over the set."""
        values = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(values), 4096):  # a long text takes no more memory than this
            np.minimum(out, (values[at : at + 4096, None] * self.odd[None, :] + self.add[None, :]).min(axis=0), out=out)
        return out.astype(np.uint64)


def probes(sketches: np.ndarray, plan: Plan) -> np.ndarray:
    """The probes of each sketch: of each part the values of all choices of its positions but t, hashed with the part and the choice."""
    parts, thresholds = plan
    out = []
    for number, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
        if t < 0:
            continue
        for kept in combinations(range(len(part)), len(part) - t):
            h = np.full(len(sketches), number * 65_536 + sum(1 << k for k in kept), np.uint64)
            for k in kept:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sketches[:, part[k]]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return np.stack(out, 1) if out else np.zeros((len(sketches), 0), np.int64)


def one_bits(sketches: np.ndarray) -> np.ndarray:
    """A bit of every position, mixed from its whole value; 64 to a number."""
    mixed = (sketches * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return np.packbits(mixed.astype(np.uint8), axis=1).view(np.int64)


def _identity(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _mapped(records: DataFrame, words: int, least: int, columns: dict, rows_at_once: int = 500) -> DataFrame:
    """(key, id, the lists named in ``columns``: functions of the shingler and the sets of some records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, least)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                keys, sets = [], []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    one = shingler.set_of(text)
                    if one is not None:
                        keys.append(key)
                        sets.append(one)
                made = columns["make"](shingler, sets)
                lists = [_lists(list(m)) for m in made]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(map(_identity, sets)), pa.int64()), *lists], names=["key", "id", *columns["names"]])

    return records.select("key", "text").mapInArrow(run, ", ".join(["key string, id bigint", *(f"{n} array<bigint>" for n in columns["names"])]))


def _sketches(shingler: Shingler, sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([shingler.sketch(s) for s in sets]) if sets else np.zeros((0, POSITIONS), np.uint64)


def hot_groups(members: DataFrame, group: str, total: int) -> DataFrame:
    """(group, blocks) of the groups of more than a limit of members: MOST_HOT groups at most, so that they may be told to all tasks.

    Counted exactly; the limit is HOT, or so many members that no more such groups can exist.
    """
    limit = max(HOT, -(-total // MOST_HOT))
    return members.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(group, F.ceil(F.col("n") / limit).cast("int").alias("blocks"))


def pairs_within(members: DataFrame, group: str, item: str, total: int, also: tuple[str, ...] = (), alike: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """(x, y), x < y: the pairs of items of a group, several times if they share several groups.

    A hot group is cut into blocks by a hash of its items, and every two of its blocks
    meet in a task of their own. ``alike`` is a condition on the columns ``also`` of
    both, named x_... and y_...; ``hot`` are the hot groups, where they are known.
    """
    hot = F.broadcast(hot_groups(members, group, total) if hot is None else hot)  # MOST_HOT rows of two numbers at most
    cut = members.join(hot, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.select(group, item, *also, "blocks", F.pmod(F.xxhash64(item), "blocks").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = cut.select(group, item, *also, "block", other.alias("other")).select(group, item, *also, "block", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("column"))
    x, y = (cells.select(group, "row", "column", *(F.col(c).alias(f"{side}_{c}") for c in (item, "block", *also))) for side in "xy")
    met = x.join(y, [group, "row", "column"]).where(F.col(f"x_{item}") < F.col(f"y_{item}")).where((F.col("row") == F.col("column")) | (F.col("x_block") != F.col("y_block")))
    return (met if alike is None else met.where(alike)).select(F.col(f"x_{item}").alias("x"), F.col(f"y_{item}").alias("y"))


#: one-bit minhashes of a record
_BITS = tuple(f"b{i}" for i in range(POSITIONS // 64))


def _apart() -> Column:
    """In how many one-bit minhashes two records differ."""
    out = F.lit(0)
    for b in _BITS:
        out = out + F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}")))
    return out


class NearDuplicates:
    """Pairs and groups of records (key, text) of at least a similarity of their shingle sets."""

    def __init__(self, records: DataFrame, key: Column, text: Column, similarity: float = 0.8, words: int = WORDS, least_words: int = LEAST_WORDS):
        if not 0 < similarity <= 1:
            raise ValueError("a similarity is above 0 and at most 1")
        with_checkpoints(records.sparkSession)
        self.records = records.select(key.cast("string").alias("key"), text.alias("text")).where("key is not null")
        self.similarity, self.words, self.least = similarity, words, least_words

    def _map(self, records: DataFrame, names: list[str], make) -> DataFrame:
        return _mapped(records, self.words, self.least, {"names": names, "make": make})

    def plan(self, count: int) -> Plan:
        """Parts and thresholds for ``count`` records, from a sample of about SAMPLE of them, chosen by a hash of the key."""
        kept = min(1.0, SAMPLE / max(count, 1))
        sampled = self.records.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000_000)) < int(kept * 1_000_000_000))
        rows = self._map(sampled, ["values"], lambda s, sets: (_sketches(s, sets).view(np.int64),)).select("id", "values").collect()
        sketches = np.array(list({r.id: r["values"] for r in sorted(rows, key=lambda r: r.id)}.values()), np.int64).reshape(-1, POSITIONS)
        return planned(sketches, count, self.similarity)

    def _linked(self) -> tuple[DataFrame, DataFrame]:
        """(different sets a < b that are similar, members (key, id)). Every text is shingled once; those of candidates once more."""
        count = self.records.count()
        plan = self.plan(count)
        number = sum(comb(len(p), len(p) - t) for p, t in zip(*plan, strict=True) if t >= 0)

        def make(shingler: Shingler, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            sketches = _sketches(shingler, sets)
            return probes(sketches, plan), one_bits(sketches)

        marked = self._map(self.records, ["probes", "bits"], make).checkpoint()
        firsts = marked.groupBy("id").agg(F.first(F.struct("probes", "bits")).alias("f"))
        spread = firsts.select("id", *(F.col("f.bits")[i].alias(b) for i, b in enumerate(_BITS)), F.explode("f.probes").alias("probe"))
        near = _apart() <= distance_bound(POSITIONS, (1 - self.similarity) / 2)
        candidates = pairs_within(spread, "probe", "id", count * number, _BITS, near).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().checkpoint()
        members = marked.select("key", "id").checkpoint()  # read often, and without the probes
        ids = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct()
        wanted = members.join(ids, "id").groupBy("id").agg(F.min("key").alias("key")).checkpoint()
        if wanted.count() <= MOST_WANTED:
            texts = self.records.join(F.broadcast(wanted.select("key")), "key", "left_semi")
        else:
            texts = self.records
        whole = self._map(texts, ["shingles"], lambda s, sets: (sets,)).join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("s"))
        sets = {side: whole.select(F.col("id").alias(side), F.col("s").alias(f"s_{side}")) for side in ("a", "b")}
        overlap = candidates.join(sets["a"], "a").join(sets["b"], "b").select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("o"), (F.size("s_a") + F.size("s_b")).alias("n"))
        linked = overlap.where(F.col("o") >= F.lit(self.similarity) * (F.col("n") - F.col("o")) - 1e-9).select("a", "b").checkpoint()
        return linked, members

    def pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b: all similar pairs of records, copies expanded."""
        linked, members = self._linked()
        members = members.distinct().checkpoint()
        total = self.records.count()
        known = hot_groups(members, "id", total).checkpoint()
        hot = F.broadcast(known)  # MOST_HOT rows of two numbers at most
        salted = members.join(hot, "id", "left").select("key", "id", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int").alias("salt"))
        across = linked
        for side, name in (("a", "k"), ("b", "l")):
            blocks = F.coalesce("blocks", F.lit(1)) - 1
            across = across.join(hot.withColumnRenamed("id", side), side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), blocks))).drop("blocks")
            across = across.join(salted.select(F.col("id").alias(side), F.col("key").alias(name), "salt"), [side, "salt"]).drop("salt")
        within = pairs_within(members, "id", "key", total, hot=known).select(F.col("x").alias("key_a"), F.col("y").alias("key_b"))
        return across.select(F.least("k", "l").alias("key_a"), F.greatest("k", "l").alias("key_b")).where("key_a < key_b").unionByName(within)

    def groups(self) -> DataFrame:
        """(key, class_id, copies, links): one row a record: its group, how many records have its set, to how many other sets it is linked."""
        linked, members = self._linked()
        sets = members.groupBy("id").agg(F.count("*").alias("copies"), F.min("key").alias("first"))
        degree = linked.select(F.col("a").alias("id")).union(linked.select("b")).groupBy("id").agg(F.count("*").alias("links"))
        found = components(linked, sets.select("id")).join(sets, "id").join(degree, "id", "left")
        names = found.groupBy("component").agg(F.min("first").alias("class_id"))
        named = found.join(names, "component").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
        return members.join(named, "id").select("key", "class_id", "copies", "links")


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the least id reachable; nodes without edges are their own. RuntimeError if ``rounds`` do not suffice."""
    found = sampling.components(edges, rounds).withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
