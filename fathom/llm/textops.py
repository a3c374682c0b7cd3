"""Vectorised text primitives over Arrow buffers.

A batch of texts is one byte buffer and its offsets; words, hashes and windows are computed for all texts of the batch at
once. Batches are cut to SLICE bytes, so working memory does not depend on the number of rows in a batch; one text longer
than that makes a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
_RNG = np.random.RandomState(20240229)
BYTE = _RNG.randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Letters and digits of ASCII and every byte of a longer UTF-8 sequence make words; the rest separates them.
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Gives free memory back to the system: a Python worker outlives its task, and would keep what the task needed."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(SLICE, 1 << int(n).bit_length()))


def prefix(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j < i of values[j] * BASE**j, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end), the same wherever the span lies."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each are about `most` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a batch: start, end (in bytes of the buffer), doc (row in the batch) and hash of each."""

    def __init__(self, texts: pa.Array, lower: str = "unicode"):
        self.raw, self.offsets = buffers(pc.utf8_lower(texts) if lower == "unicode" else texts)
        self.rows = len(self.offsets) - 1
        n = len(self.raw)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = WORD[self.raw]
        start, end = inside[1:-1] > inside[:-2], inside[1:-1] > inside[2:]
        edge = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]  # a word ends with its text
        start[edge] = inside[1:-1][edge] > 0
        last = edge[edge > 0] - 1
        end[last] = inside[1:-1][last] > 0
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        low = self.raw if lower == "unicode" else LOWER[self.raw]
        self.hash = spans(prefix(BYTE[low]), self.start, self.end)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        #: first[i]:first[i + 1] are the words of text i
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)


TERM_BITS = 44


def unique_terms(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, term) pairs in order of doc, then of term; terms are cut to their upper TERM_BITS bits."""
    low = np.uint64(64 - TERM_BITS)
    key = np.sort(doc.astype(np.uint64) << np.uint64(TERM_BITS) | term >> low)
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return (key >> np.uint64(TERM_BITS)).astype(np.int64), key & np.uint64((1 << TERM_BITS) - 1)


def hash_words(text: str) -> np.ndarray:
    return Words(pa.array([text])).hash
