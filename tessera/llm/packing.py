"""Texts assigned to containers of a fixed number of tokens.

One narrow pass, no shuffle: each partition packs its own stream of texts in
groups. A group is packed by bin completion: around its largest item the
undominated fillings are enumerated, branches are pruned by the waste that a
better solution could still afford, and best fit decreasing is the first
incumbent. Every group is searched that best fit does not already pack in as few
containers as a lower bound allows; a search ends after ``WORK`` items tried, that of
a container's fillings after ``STEPS`` items or ``FILLINGS`` found, and the best
solution so far stands. ``proved`` says whether it is known to have the fewest containers.
Containers that are not nearly full give their items back to the next group, so
that unused room is left only in the last containers of a partition.

A text is divided only if it alone exceeds the container: into full containers
and a rest, cut where no word is divided if that is possible. Null texts are not
assigned; an empty text takes no room. Repeated texts are items of their own.
Container numbers are the partition's number and a count, so they are unique and
the same when a task runs again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens as T

SCHEMA = "doc_id bigint, piece int, char_start int, char_end int, tokens int, container bigint, place int, proved boolean"
GROUP = 256
NEARLY_FULL = 0.995
#: items tried in the search of a group; to fill one container; fillings of it that are branched on; containers of a partial search
WORK, STEPS, FILLINGS, PART = 60_000, 120, 24, 24


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each item into the container with the least sufficient room."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(rooms, (room - sizes[i], b))
    return bins


def _fits_into(small: list[int], large: list[int]) -> bool:
    """Whether the items ``small`` can be put into the items ``large`` as if those were containers."""
    rooms = sorted(large)
    for s in sorted(small, reverse=True):
        at = bisect_left(rooms, s)
        if at == len(rooms):
            return False
        insort(rooms, rooms.pop(at) - s)
    return True


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound on the number of containers, by dual feasible functions.

    Each maps sizes so that what fits into one container still does: the sizes
    themselves; for k from 1 to 12, floor((k + 1) x / C) / k where (k + 1) x / C is
    no integer, else x / C; and for a threshold e, large items (above C - e) as whole
    containers and small ones (under e) as nothing.
    """
    if not sizes:
        return 0
    x = np.sort(np.array(sizes, np.int64))
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 13):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        # In units of 1 / (k C).
        total = int(np.where(whole, k * x, scaled // capacity * capacity).sum())
        best = max(best, -(-total // (k * capacity)))
    sums = np.concatenate(([0], np.cumsum(x)))
    thresholds = np.unique(x[2 * x <= capacity])
    if len(thresholds):
        large = len(x) - np.searchsorted(x, capacity - thresholds, "right")
        low, high = np.searchsorted(x, thresholds), len(x) - large
        # Large items fill containers; the others must share the remaining ones.
        best = max(best, int((large + -(-(sums[high] - sums[low]) // capacity)).max()))
    return best


def fillings(rest: list[int], sizes: list[int], room: int, most: int = FILLINGS, steps: int = STEPS) -> tuple[list[tuple[int, ...]], bool, int]:
    """Undominated fillings of a room by items of ``rest`` (descending), fullest first; whether these are all; items tried.

    A filling is dominated if its items could be put into those of another that
    fits. At most ``steps`` items are tried and ``most`` fillings kept.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    tried, whole_search = 0, True
    falling = [-sizes[i] for i in rest]
    #: the next item to try, room left and items chosen, deepest last
    path: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while path:
        start, left, chosen = path.pop()
        # The next item that fits, and later the same choice without items of its size.
        k = bisect_left(falling, -left, start)
        if k >= len(rest):
            found.append((left, chosen))
            continue
        size = sizes[rest[k]]
        tried += 1
        if tried > steps:
            whole_search = False
            # What was begun is completed with the largest items that fit.
            while k < len(rest):
                left, chosen = left - sizes[rest[k]], (*chosen, rest[k])
                k = bisect_left(falling, -left, k + 1)
            found.append((left, chosen))
            break
        after = bisect_right(falling, -size, k)
        if after < len(rest):
            path.append((after, left, chosen))
        path.append((k + 1, left - size, (*chosen, rest[k])))
    found.sort(key=lambda x: x[0])
    kept: list[tuple[int, ...]] = []
    for _, chosen in found:
        mine = [sizes[i] for i in chosen]
        if not any(_fits_into(mine, [sizes[i] for i in other]) for other in kept):
            if len(kept) == most:
                return kept, False, tried
            kept.append(chosen)
    return kept or [()], whole_search, tried


def _complete(sizes: list[int], capacity: int, best: list[list[int]], bound: int, work: int) -> tuple[list[list[int]], bool]:
    """Branch and bound from an incumbent: (the best solution found, whether it is proved to have the fewest containers)."""
    total, proved = sum(sizes), True
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    #: the path of the search, a frame a container: its largest item, the others, the fillings left to try, room wasted before; no recursion, as a path may be as long as the pool
    path: list[tuple[int, list[int], Iterator[tuple[int, ...]], int]] = []
    done: list[list[int]] = []

    def enter(rest: list[int], wasted: int) -> None:
        nonlocal best, proved, work
        if not rest:
            if len(done) < len(best):
                best = [list(b) for b in done]
            return
        # A better solution has fewer containers, and so only this much room to waste.
        affordable = (len(best) - 1) * capacity - total
        if wasted > affordable or len(done) + 1 >= len(best) or len(best) <= bound:
            return
        options, whole, tried = fillings(rest[1:], sizes, capacity - sizes[rest[0]])
        proved, work = proved and whole, work - tried
        path.append((rest[0], rest[1:], iter(options), wasted))

    enter(order, 0)
    while path and work > 0 and len(best) > bound:
        first, others, untried, wasted = path[-1]
        del done[len(path) - 1 :]
        chosen = next(untried, None)
        if chosen is None:
            path.pop()
            continue
        work -= 1
        left = capacity - sizes[first] - sum(sizes[i] for i in chosen)
        # The room left in the last container is no waste that counts.
        if len(chosen) < len(others) and wasted + left > (len(best) - 1) * capacity - total:
            path.pop()
            continue
        taken = set(chosen)
        done.append([first, *chosen])
        enter([i for i in others if i not in taken], wasted + left)
    return best, len(best) <= bound or (proved and not path)


def pack(sizes: list[int], capacity: int, work: int = WORK) -> tuple[list[list[int]], bool]:
    """(items by place in ``sizes``, none above ``capacity``, in containers; whether these are proved to be the fewest).

    Best fit decreasing is the first incumbent; where it is not as good as a lower
    bound, the pool is searched by bin completion, within ``work`` items tried. What
    the search could not prove is searched again in parts: the emptiest containers
    with as many others, as long as that saves a container.
    """
    best = best_fit(sizes, capacity)
    bound = least_containers(sizes, capacity)
    if len(best) <= bound:
        return best, True
    best, proved = _complete(sizes, capacity, best, bound, work)
    while not proved and len(best) > bound:
        best.sort(key=lambda b: sum(sizes[i] for i in b))
        part, kept = best[:PART], best[PART:]
        items = [i for b in part for i in b]
        own = [sizes[i] for i in items]
        floor = least_containers(own, capacity)
        if len(part) <= floor or len(part) == len(best):
            break
        incumbent = best_fit(own, capacity)
        found, _ = _complete(own, capacity, incumbent if len(incumbent) < len(part) else _places(part), floor, work // 4)
        if len(found) >= len(part):
            break
        best = kept + [[items[i] for i in b] for b in found]
    return best, proved or len(best) <= bound


def _places(part: list[list[int]]) -> list[list[int]]:
    """Containers with their items counted through."""
    out, at = [], 0
    for b in part:
        out.append(list(range(at, at + len(b))))
        at += len(b)
    return out


def divide(text: str, capacity: int, path: str = T.VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the parts of a text: one if it fits, else full ones and a rest."""
    ids = T.ids(text, path)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids))]
    from tessera.llm.splitting import Tokenised

    t, out, start = Tokenised(text, path), [], 0
    while t.count - start > capacity:
        end = start + capacity
        place = next((k for k in range(end, max(start, end - 48), -1) if t.words[k]), None) or next((k for k in range(end, start, -1) if t.clean[k]), end)
        a, z = int(t.places[start]), int(t.places[place])
        n = T.count(text[a:z], path)
        while n > capacity:  # a part alone may be read into other tokens than within its text
            place = next((k for k in range(place - 1, start, -1) if t.clean[k]), place - 1)
            z = int(t.places[place])
            n = T.count(text[a:z], path)
        out.append((a, z, n))
        start = place
    a = int(t.places[start])
    rest = text[a:]
    n = T.count(rest, path)
    return [*out, *((s + a, e + a, k) for s, e, k in divide(rest, capacity, path))] if n > capacity else [*out, (a, len(text), n)]


def _assign(capacity: int, group: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        pool: list[tuple] = []
        rows: list[tuple] = []

        def settle(last: bool) -> None:
            nonlocal pool, number
            sizes = [p[4] for p in pool]
            bins, proved = pack(sizes, capacity)
            filled = sorted(((sum(sizes[i] for i in b), b) for b in bins), key=lambda x: -x[0])
            back: list[tuple] = []
            room_left = 3 * group
            for full, members in filled:
                if not last and full < NEARLY_FULL * capacity and len(back) + len(members) <= room_left:
                    back += [pool[i] for i in members]
                    continue
                rows.extend((*pool[i], number, k, proved) for k, i in enumerate(members))
                number += 1
            pool = back

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            names = ["doc_id", "piece", "char_start", "char_end", "tokens", "container", "place", "proved"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        fresh = 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, part in enumerate(divide(text, capacity, path)):
                    pool.append((key, n, *part))
                    fresh += 1
                if fresh >= group:
                    settle(False)
                    fresh = 0
            if rows:
                yield flush()
                rows = []
        if pool:
            settle(True)
        if rows:
            yield flush()

    return run


def containers(texts: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", group: int = GROUP, path: str = T.VOCABULARY) -> DataFrame:
    """Each text, or part of one that exceeds ``capacity``, with its container, its place in it and whether its group's containers are proved to be the fewest."""
    if capacity < 1:
        raise ValueError("a container holds one token at least")
    return texts.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_assign(capacity, group, path), SCHEMA)


def usage(assigned: DataFrame, capacity: int) -> DataFrame:
    """Containers by how full they are, in twentieths."""
    full = assigned.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return full.groupBy(F.floor(F.col("tokens") * 20 / capacity).cast("int").alias("twentieth")).agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
