"""Small caches on the driver: of search results, and of query vectors."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from ..functions.hashing import length_prefixed_sha256


class QueryCache:
    """Least recently used goes first; an entry lives for ttl seconds, and only within its generation."""

    def __init__(self, capacity: int = 256, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.ttl, self.clock = capacity, ttl, clock
        self.generation = self.hits = self.misses = self.evictions = 0
        self._entries: OrderedDict[bytes, tuple[Any, int, float]] = OrderedDict()

    def get(self, key: bytes) -> Any | None:
        entry = self._entries.get(key)
        if entry and entry[1] == self.generation and self.clock() - entry[2] <= self.ttl:
            self._entries.move_to_end(key)
            self.hits += 1
            return entry[0]
        self._entries.pop(key, None)
        self.misses += 1
        return None

    def insert(self, key: bytes, value: Any, capacity: int | None = None) -> None:
        most = min(self.capacity, self.capacity if capacity is None else capacity)
        if most <= 0:
            return
        while len(self._entries) >= most and key not in self._entries:
            self._entries.popitem(last=False)
            self.evictions += 1
        self._entries[key] = (value, self.generation, self.clock())
        self._entries.move_to_end(key)

    def invalidate(self) -> None:
        self.generation += 1

    def clear(self) -> None:
        self.invalidate()
        self._entries.clear()

    def __len__(self) -> int:
        return len(self._entries)

    @staticmethod
    def key(query: str, inputs: bytes, mode: str, grouping: str | None, limit: int, offset: int) -> bytes:
        """The query as it was typed, and all that the result hangs on."""
        return length_prefixed_sha256(query.encode(), inputs, mode.encode(), str(grouping).encode(), str(limit).encode(), str(offset).encode())


class EmbeddingCache:
    """Vectors of normalised queries."""

    def __init__(self, capacity: int = 500):
        self.capacity = capacity
        self._entries: OrderedDict[str, Any] = OrderedDict()

    def get(self, text: str) -> Any | None:
        if text in self._entries:
            self._entries.move_to_end(text)
        return self._entries.get(text)

    def insert(self, text: str, vector: Any) -> None:
        if self.capacity <= 0:
            return
        if text not in self._entries and len(self._entries) >= self.capacity:
            self._entries.popitem(last=False)
        self._entries[text] = vector
        self._entries.move_to_end(text)

    def clear(self) -> None:
        self._entries.clear()

    def __len__(self) -> int:
        return len(self._entries)
