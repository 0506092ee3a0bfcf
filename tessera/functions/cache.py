"""An exact result cache: least recently used, with a time to live, under a key that names all that decides the result."""

from __future__ import annotations

import copy
import hashlib
import json
import unicodedata
from collections import OrderedDict
from collections.abc import Callable
from time import monotonic


def result_key(identity: str, query: str, k: int, filters: dict | None = None) -> str:
    text = " ".join(unicodedata.normalize("NFC", query).split())
    return hashlib.sha256(json.dumps([identity, text, k, filters or {}], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class ResultCache:
    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = monotonic):
        if most < 1 or seconds <= 0:
            raise ValueError("room for one result and a positive time are needed")
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.counts = {"hits": 0, "misses": 0, "expired": 0, "evicted": 0}

    def get(self, key: str):
        there = self.held.get(key)
        if there and self.clock() - there[0] <= self.seconds:
            self.held.move_to_end(key)
            self.counts["hits"] += 1
            return copy.deepcopy(there[1])
        if there:
            del self.held[key]
            self.counts["expired"] += 1
        self.counts["misses"] += 1
        return None

    def put(self, key: str, value) -> None:
        self.held[key] = (self.clock(), copy.deepcopy(value))
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
            self.counts["evicted"] += 1


def replay(keys: list[str], most: int, seconds: float, times: list[float]) -> dict[str, int]:
    """The counts of a cache that is asked for keys at given times, each put in where it was missing."""
    now = [0.0]
    cache = ResultCache(most, seconds, lambda: now[0])
    for key, at in zip(keys, times, strict=True):
        now[0] = at
        if cache.get(key) is None:
            cache.put(key, key)
    return dict(cache.counts)
