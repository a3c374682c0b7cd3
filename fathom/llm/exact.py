"""Exact dedup (9): counting quotient filters find the fingerprints that occur more than once; bytes decide.

Every partition of the corpus builds one counting quotient filter for each range of fingerprints. The filters of a range
are merged by a walk over their sorted remainders, which loses nothing: the merged filter is the one that all the rows
together would have built. Only texts whose fingerprint has a count above one are compared byte for byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import table
from .names import free

#: Largest set of repeated fingerprints, in bytes as written, that is sent to every executor; beyond it they are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Fingerprints to a range, about: what one task merges.
RANGE_ROWS = 2_000_000


class CountingQuotientFilter:
    """A quotient filter with counts. A fingerprint of `bits` bits is a quotient, which says where its run should lie, and a
    remainder, which is stored. Runs lie in order of their quotients, remainders ascend within a run, and two bits a slot
    (occupied, by quotient; run end, by slot) tell which run belongs to which quotient. A slot with a count above one has
    an entry in `counts`."""

    def __init__(self, bits: int, q: int, occupied: np.ndarray, runend: np.ndarray, slot: np.ndarray, remainder: np.ndarray, counts: np.ndarray):
        self.bits, self.q, self.occupied, self.runend, self.slot, self.remainder, self.counts = bits, q, occupied, runend, slot, remainder, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = 64) -> CountingQuotientFilter:
        """Of fingerprints in any order, with repeats; counts: how often each of them counts."""
        order = np.argsort(fingerprints, kind="stable")
        values = fingerprints[order]
        weight = np.ones(len(values), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        return cls._of(values[first], np.add.reduceat(weight, first) if len(first) else weight, bits)

    @classmethod
    def _of(cls, unique: np.ndarray, total: np.ndarray, bits: int) -> CountingQuotientFilter:
        """Of different fingerprints in ascending order, and their counts."""
        q = max(1, int(len(unique) * 4 // 3).bit_length())
        quotient = (unique >> np.uint64(bits - q)).astype(np.int64)
        n = np.arange(len(unique))
        slot = n + np.maximum.accumulate(quotient - n) if len(unique) else n  # linear probing of sorted quotients
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        runend = np.zeros(int(slot[-1]) + 1 if len(slot) else 0, bool)
        runend[slot[np.concatenate([quotient[1:] != quotient[:-1], [True]])] if len(slot) else slot] = True
        return cls(bits, q, occupied, runend, slot, unique & np.uint64((1 << (bits - q)) - 1), total)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in ascending order, counts), read back from the slots."""
        if not len(self.slot):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ends = np.cumsum(self.runend[self.slot])
        run = ends - self.runend[self.slot]
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return quotient << np.uint64(self.bits - self.q) | self.remainder, self.counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Of all that both were built of. Both lists of items ascend: one's go to their places in the other's."""
        (a, n), (b, m) = self.items(), other.items()
        at = np.searchsorted(a, b)
        both = np.zeros(len(b), bool)
        if len(a):
            both = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)
        n = n.copy()
        n[at[both]] += m[both]
        return self._of(np.insert(a, at[~both], b[~both]), np.insert(n, at[~both], m[~both]), self.bits)

    def count(self, fingerprint: int) -> int:
        keys, counts = self.items()
        at = np.searchsorted(keys, np.uint64(fingerprint))
        return int(counts[at]) if at < len(keys) and keys[at] == np.uint64(fingerprint) else 0

    def dumps(self) -> bytes:
        many = np.flatnonzero(self.counts > 1)
        used = np.zeros(len(self.runend), bool)
        used[self.slot] = True
        parts = [np.packbits(self.occupied), np.packbits(self.runend), np.packbits(used), self.remainder.astype("<u8"), many.astype("<u4"), self.counts[many].astype("<i8")]
        return np.array([self.bits, self.q, len(self.runend), len(self.remainder), len(many)], "<i8").tobytes() + b"".join(x.tobytes() for x in parts)

    @classmethod
    def loads(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, slots, n, many = (int(x) for x in np.frombuffer(data, "<i8", 5))
        at = 40

        def take(dtype: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, k, at)
            at += out.nbytes
            return out

        bitmap = lambda k: np.unpackbits(take("u1", -(-k // 8)), count=k).astype(bool)
        occupied, runend, used = bitmap(1 << q), bitmap(slots), bitmap(slots)
        remainder, which, more = take("<u8", n).astype(np.uint64), take("<u4", many), take("<i8", many)
        counts = np.ones(n, np.int64)
        counts[which] = more
        return cls(bits, q, occupied, runend, np.flatnonzero(used), remainder, counts)


def _filters(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    got = [np.zeros(0, np.int64)]
    for b in batches:
        got.append(b.column(0).to_numpy(zero_copy_only=False))
    fp = np.concatenate(got).view(np.uint64)
    if not len(fp):
        return
    shard = (fp >> np.uint64(32)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "filter": pa.array([CountingQuotientFilter.build(fp[order[cuts[k] : cuts[k + 1]]]).dumps()], pa.binary())})


def _repeated(group: pa.Table) -> pa.Table:
    merged: list[CountingQuotientFilter] = [CountingQuotientFilter.loads(x.as_py()) for x in group.column("filter")]
    while len(merged) > 1:  # pairwise, so that each item is merged log n times
        merged = [merged[i].merge(merged[i + 1]) if i + 1 < len(merged) else merged[i] for i in range(0, len(merged), 2)]
    keys, counts = merged[0].items()
    return pa.table({"fp": pa.array(keys[counts > 1].view(np.int64), pa.int64())})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """fp of every fingerprint (the one bigint column, of about so many rows) that occurs more than once."""
    shards = max(1, int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE_ROWS))
    filters = fingerprints.mapInArrow(lambda it: _filters(it, shards), "shard int, filter binary")
    return filters.groupBy("shard").applyInArrow(_repeated, "fp bigint")


def _marked(docs: DataFrame, text: str) -> tuple[DataFrame, Column, Column]:
    """docs with the fingerprint of its text and whether this occurs again; the two columns' names are not in docs."""
    fp, dup = free(docs, "fp", "dup")
    known = table(repeated_fingerprints(docs.where(F.col(text).isNotNull()).select(F.xxhash64(text)), docs.count()), "repeated")
    right = known.df.select(F.col("fp").alias(dup))
    right = F.broadcast(right) if known.bytes <= BROADCAST_BYTES else right
    marked = docs.withColumn(fp, F.when(F.col(text).isNotNull(), F.xxhash64(text)))
    return marked.join(right, F.col(fp) == F.col(dup), "left"), F.col(fp), F.col(dup)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, keep_id (the smallest id with the same bytes of text), copies (rows with that text) and
    is_copy (keep_id is another id).

    A null text is a copy of nothing: keep_id is its own id, copies 1. An empty text is a text like any other. Repeated rows
    count as copies of each other; they share their id, so is_copy is false for each of them. A null id is never the
    smallest unless all of a group are null, and then keep_id is null. Other columns are not read. No rows give no rows."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d, fp, dup = _marked(d, "text")
    alone = d.where(dup.isNull()).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    groups = d.where(dup.isNotNull()).groupBy("fp", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).select(F.sha2("text", 256).alias("sha"), "keep_id", "copies")
    members = d.where(dup.isNotNull()).select("doc_id", F.sha2("text", 256).alias("sha"))
    rest = members.join(groups, "sha").select("doc_id", "keep_id", "copies")
    return alone.unionByName(rest).withColumn("is_copy", F.coalesce(F.col("keep_id") != F.col("doc_id"), F.lit(False)))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each text, the one with the smallest id (a null id is the largest); all columns stay.

    Rows with a null text all stay. Of repeated rows one stays. No rows give no rows."""
    marked, fp, dup = _marked(docs, text_col)
    (rn,) = free(marked, "rn")
    w = Window.partitionBy(fp, F.col(text_col)).orderBy(F.col(id_col).asc_nulls_last())
    kept = marked.where(dup.isNotNull()).withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1)
    return marked.where(dup.isNull()).select(docs.columns).unionByName(kept.select(docs.columns))


ORACLE_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies,
       coalesce(text IS NOT NULL AND min(doc_id) OVER (PARTITION BY text) <> doc_id, false) AS is_copy
FROM documents
"""
