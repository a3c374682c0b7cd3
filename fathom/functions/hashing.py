"""Identities and fingerprints. 64-bit values are kept in bigint as their bit pattern."""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
#: Books whose lines are Python objects at the same time, and bytes that are hashed together.
BOOKS_AT_ONCE, HASHED_BYTES = 256, 8 << 20


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unsigned(x: int) -> int:
    return x & MASK


def unsigned_text(x: Column) -> Column:
    """The unsigned decimal of a bit pattern."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)").cast("string")


def line_id(catalogue_order: Column, ordinal: Column) -> Column:
    """The global id of a line: both halves count from one."""
    return F.shiftleft(catalogue_order.cast("bigint") + 1, 32) + ordinal + 1


def chunk_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def semantic_id(book_key: Column, line: Column, identity: int) -> Column:
    """identity: the chunking identity, unsigned."""
    return F.substring(F.sha2(F.concat_ws(":", book_key, line.cast("string"), F.lit(str(unsigned(identity)))), 256), 1, 32)


@dataclass(frozen=True)
class ChunkerConfig:
    min_meaningful_chars: int = 20
    context_window_lines: int = 2
    max_chunk_chars: int = 512
    min_embeddable_chars: int = 5
    chunking_version: int = 1

    @property
    def identity(self) -> int:
        """Changes with every number that changes what is embedded; unsigned."""
        fields = self.min_meaningful_chars, self.context_window_lines, self.max_chunk_chars, self.min_embeddable_chars, self.chunking_version
        return struct.unpack("<Q", hashlib.sha256(struct.pack("<5Q", *fields)).digest()[:8])[0]


def fnv1a(data: bytes, state: int = OFFSET) -> int:
    for b in data:
        state = ((state ^ b) * PRIME) & MASK
    return state


def fnv1a_many(items: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings, one byte of all of them at a time; when few are left they are finished one by one."""
    size = np.array([len(x) for x in items], np.int64)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    data = np.frombuffer(b"".join(items), np.uint8)
    state = np.full(len(items), OFFSET, np.uint64)
    shorter = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")  # how many reach each byte
    at = 0
    while at < len(shorter) and shorter[at] >= 32:
        n = shorter[at]
        state[:n] = (state[:n] ^ data[start[:n] + at]) * np.uint64(PRIME)
        at += 1
    out = np.empty(len(items), np.uint64)
    for k, i in enumerate(order):
        out[i] = fnv1a(items[i][at:], int(state[k])) if size[i] > at else state[k]
    return out


def _fields(*fields: bytes) -> bytes:
    """Each behind its length."""
    return b"".join(struct.pack("<Q", len(f)) + f for f in fields)


def fnv1a_column(text: Column) -> Column:
    """FNV-1a of a text's bytes; a null text is an empty one."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fnv1a_many([(t or "").encode() for t in s]).view(np.int64))

    return run(text)


def canonical_facets(facets) -> list[str]:
    return sorted({f for f in facets if f.strip()}, key=lambda f: f.encode())


def canonical_bytes(source: int, title: str, topics: str, facets, is_pdf: bool) -> bytes:
    return _fields(struct.pack("<Q", unsigned(source)), title.encode(), topics.encode(), bytes([is_pdf]), *(f.encode() for f in canonical_facets(facets)))


def canonical_fingerprint(source: int, title: str, topics: str, facets, is_pdf: bool) -> int:
    """Of a book's content and what is stored of it in each vector; unsigned, 0 (unverifiable) only for a source of 0."""
    return (fnv1a(canonical_bytes(source, title, topics, facets, is_pdf)) or 1) if source else 0


def canonical_fingerprint_column(source: Column, title: Column, topics: Column, facets: Column, is_pdf: Column) -> Column:
    @F.pandas_udf("bigint")
    def run(s: pd.Series, t: pd.Series, p: pd.Series, f: pd.Series, d: pd.Series) -> pd.Series:
        h = fnv1a_many([canonical_bytes(int(a), b, c, e, bool(g)) for a, b, c, e, g in zip(s, t, p, f, d)])
        return pd.Series(np.where(s.to_numpy() == 0, np.uint64(0), np.maximum(h, np.uint64(1))).view(np.int64))

    return run(source, title, topics, facets, is_pdf)


def line_fingerprints(books: DataFrame, lines: DataFrame) -> DataFrame:
    """source_book_key and line_fingerprint of every book with its lines in order. The lines of a book are gathered in one row, so a
    book must fit in memory, as it does wherever it is chunked. A book without lines has a fingerprint too."""
    fields = "line_id", "section_id", "segment", "line_hash", "reference", "text"
    gathered = lines.groupBy("source_book_key").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("lines"))
    rows = books.select("source_book_key", "title", "topics", "is_pdf", "extra_facets").join(gathered, "source_book_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hashes, out, held = b.column("source_book_key"), [np.zeros(0, np.int64)], [], 0
            for at in range(0, b.num_rows, BOOKS_AT_ONCE):  # a batch may hold 10,000 books, which as Python objects are many times as large
                part = b.slice(at, BOOKS_AT_ONCE)
                heads = zip(*(part.column(c).to_pylist() for c in ("title", "topics", "is_pdf", "extra_facets")))
                flat = part.column("lines").flatten()  # the lines of all these books, one behind the other
                numbers = zip(*(flat.field(n).cast(pa.int64()).to_pylist() for n in fields[:4]))
                texts = zip(*(flat.field(n).to_pylist() for n in fields[4:]))
                lines_ = (_fields(*(struct.pack("<q", x) for x in n), *((t or "").encode() for t in ts)) for n, ts in zip(numbers, texts))
                for (title, topics, is_pdf, facets), n in zip(heads, part.column("lines").value_lengths().fill_null(0).to_pylist()):
                    head = _fields(title.encode(), topics.encode(), bytes([bool(is_pdf)]), *(f.encode() for f in canonical_facets(facets)), struct.pack("<Q", n))
                    out.append(head + b"".join(itertools.islice(lines_, n)))
                    held += len(out[-1])
                if held > HASHED_BYTES:
                    hashes.append(fnv1a_many(out).view(np.int64))
                    out, held = [], 0
            hashes.append(fnv1a_many(out).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(hashes))], ["source_book_key", "line_fingerprint"])

    return rows.mapInArrow(run, "source_book_key string, line_fingerprint bigint")


def length_prefixed_sha256(*fields: bytes) -> bytes:
    h = hashlib.sha256()
    for f in fields:
        h.update(struct.pack("<Q", len(f)))
        h.update(f)
    return h.digest()
