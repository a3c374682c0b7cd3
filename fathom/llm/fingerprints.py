"""Document fingerprints (1): prefix polynomial hashes.

H[i] is the sum of c[j] * B**j over the first i characters, modulo a prime. With the array of a text any span's hash is two
look-ups, so spans are compared in constant time, and the longest common extension of two places is a binary search. Two
primes of 31 bits are used together; all texts of a slice share one pair of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import buffers, slices

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASE = 1_000_003


@lru_cache(maxsize=8)
def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have, step = 1, base % prime
    while have < n:  # doubling: base ** (have + k) = base ** have * base ** k
        k = min(have, n - have)
        out[have : have + k] = out[:k] * step % prime
        step = step * step % prime
        have *= 2
    return out


def powers(prime: int, base: int, n: int) -> np.ndarray:
    return _powers(prime, base, 1 << max(16, (n - 1).bit_length()))


class PrefixHashes:
    """Of the characters (code points) of some texts: text i has characters first[i]:first[i + 1]."""

    def __init__(self, texts: pa.Array):
        raw, offsets = buffers(texts)
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        self.first = starts[offsets]
        self.chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        n = len(self.chars)
        self.sums, self.inverse = [], []
        for p in PRIMES:
            out = np.zeros(n + 1, np.int64)
            terms = self.chars * powers(p, BASE, n + 1)[:n] % p
            np.cumsum(terms, out=out[1:])
            self.sums.append(out % p)
            self.inverse.append(powers(p, pow(BASE, -1, p), n + 1))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of spans [start, end), the same wherever a span lies."""
        return tuple((s[end] - s[start]) % p * v[start] % p for p, s, v in zip(PRIMES, self.sums, self.inverse))

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether [a, a + n) and [b, b + n) have the same characters."""
        return np.logical_and(*(x == y for x, y in zip(self.hashes(a, a + n), self.hashes(b, b + n))))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many characters from a and b on are the same, up to most; back: how many before them."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle) if back else self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _lines(h: PrefixHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every line; an empty text has one, which is empty."""
    breaks = np.flatnonzero(h.chars == 10)
    start = np.sort(np.concatenate([h.first[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, h.first[1:]]), kind="stable")
    text = np.sort(np.concatenate([np.arange(len(h.first) - 1), np.searchsorted(h.first, breaks, "right") - 1]), kind="stable")
    return text, start, end


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h = PrefixHashes(b.column("text"))
        rows = b.num_rows
        text, start, end = _lines(h)
        x, y = h.hashes(start, end)
        order = np.lexsort((end - start, y, x, text))
        t, k = text[order], np.stack([x, y, end - start], 1)[order]
        again = (t[1:] == t[:-1]) & (k[1:] == k[:-1]).all(1)
        repeated = np.bincount(t[1:][again], minlength=rows)
        near = np.flatnonzero(text[1:] == text[:-1])
        reach = h.extension(start[near], start[near + 1], np.minimum(end[near] - start[near], end[near + 1] - start[near + 1]))
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, text[near], reach)
        a, c = h.hashes(h.first[:-1], h.first[1:])
        null = b.column("text").is_null().to_numpy(zero_copy_only=False)
        value = lambda v: pa.array(v.astype(np.int64), mask=null)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "chars": value(np.diff(h.first)), "fingerprint_a": value(a), "fingerprint_b": value(c), "lines": value(np.bincount(text, minlength=rows)), "repeated_lines": value(repeated), "common_start": value(longest)})


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, chars (code points), fingerprint_a and fingerprint_b (the text's hash modulo each prime), lines,
    repeated_lines (lines equal to an earlier one of the text) and common_start (the most characters that two lines in
    succession both begin with).

    A null text has nulls. An empty text has hashes 0 and one line. Repeated rows are hashed each for itself, a null id stays
    null, other columns are not read, no rows give no rows."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_fingerprinted, "doc_id bigint, chars bigint, fingerprint_a bigint, fingerprint_b bigint, lines bigint, repeated_lines bigint, common_start bigint")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(slices(iter([whole]), "left_text"), "right_text"):
            n = b.num_rows
            h = PrefixHashes(pa.concat_arrays([b.column("left_text"), b.column("right_text")]))
            a, z = h.first[:n], h.first[1 : n + 1]
            c, y = h.first[n : 2 * n], h.first[n + 1 :]
            most = np.minimum(z - a, y - c)
            yield pa.RecordBatch.from_pydict({"left_id": b.column("left_id"), "right_id": b.column("right_id"), "prefix": h.extension(a, c, most), "suffix": h.extension(z, y, most, back=True)})


def extensions(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """left_id, right_id, prefix and suffix: of every row of pairs, how many characters the two documents begin and end with alike.

    A pair of which an id isn't in docs, or is null, gives no row; a null text is an empty one. An id that docs has in several
    rows gives a row for each."""
    side = lambda s: docs.select(F.col(id_col).cast("bigint").alias(f"{s}_id"), F.col(text_col).alias(f"{s}_text"))
    joined = pairs.select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    return joined.select("left_id", "right_id", "left_text", "right_text").mapInArrow(_compared, "left_id bigint, right_id bigint, prefix bigint, suffix bigint")


def oracle_sql() -> str:
    codes = "list_transform(list_reverse(string_split(text, '')), lambda c: ord(c)::BIGINT)"
    horner = lambda p: f"CASE WHEN text = '' THEN 0 WHEN text IS NULL THEN NULL ELSE list_reduce({codes}, lambda h, c: (h * {BASE} + c) % {p}) END"
    line = "string_split(text, chr(10))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, {line} AS l FROM documents),
pairs AS (SELECT rid, l[i] AS a, l[i + 1] AS b FROM (SELECT rid, l, unnest(generate_series(1, len(l) - 1)) AS i FROM d)),
zipped AS (SELECT rid, a, b, list_position(list_transform(list_zip(string_split(a[1:least(len(a), len(b))], ''), string_split(b[1:least(len(a), len(b))], '')), lambda z: z[1] = z[2]), false) AS d FROM pairs),
starts AS (SELECT rid, max(CASE WHEN a = '' OR b = '' THEN 0 WHEN d IS NULL OR d = 0 THEN least(len(a), len(b)) ELSE d - 1 END) AS m FROM zipped GROUP BY rid)
SELECT doc_id, len(text)::BIGINT AS chars, {horner(PRIMES[0])} AS fingerprint_a, {horner(PRIMES[1])} AS fingerprint_b,
       len(l)::BIGINT AS lines, (len(l) - len(list_distinct(l)))::BIGINT AS repeated_lines,
       CASE WHEN text IS NOT NULL THEN coalesce(m, 0)::BIGINT END AS common_start
FROM d LEFT JOIN starts USING (rid)
"""
