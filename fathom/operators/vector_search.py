"""Exact cosine search. Vectors that can't be compared (null, of another dimension, with a null, NaN or infinite component, or without a
direction) are never found, and a query of that kind finds nothing.

One query: every task multiplies its Arrow batches by the query with numpy in single precision, which is a matter of memory
bandwidth, computes what could be among the best k again in double precision, and keeps k rows; these are sorted. Many queries: their
matrix is sent to every task if its size and that of a task's answers allow, and multiplied beside the vectors, so that only k rows a
query and task are shuffled; beyond that size every block of queries is a task past which all vectors stream, and only the k best of
each query leave it. Here too single precision finds what could be among the best, and double precision decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import MIN_NORM
from .filters import SearchFilters

#: Vectors and queries to a block.
BLOCK = 2048
QUERY_BLOCK = 8192
#: Largest matrix of queries, and largest answer of a task, in bytes, where the matrix is sent to every task.
BROADCAST_BYTES = 16 << 20
#: Scores are compared as rounded to so many places, so that the order doesn't hang on the order of summation.
PLACES = 9


def comparable(query: list[float]) -> bool:
    """Whether a query vector has a direction; without one the result is empty."""
    v = np.asarray(query, float)
    return bool(len(v) and np.isfinite(v).all() and MIN_NORM < np.linalg.norm(v) < np.inf)


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """vectors with the column vector as the bytes of its float32 components. Searches take either kind; bytes go to Python as they are,
    while an array is copied component by component."""
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [None if x is None or any(y is None for y in x) else np.asarray(x, "<f4").tobytes() for x in b.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if c == "vector" else b.column(c) for c in names], names)

    return vectors.mapInArrow(run, ", ".join(f"`{c}` {'binary' if c == 'vector' else t}" for c, t in vectors.dtypes))


def _matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have dim components, none of them null, and their matrix); dim None is that of the first row that has any."""
    width = 4 if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else 1
    size = pc.fill_null(pc.binary_length(column) if width == 4 else pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(size[np.argmax(size > 0)]) // width if (size > 0).any() else 0
    rows = np.flatnonzero((size == dim * width) & (size > 0))
    if len(rows) < len(size):
        column = column.take(pa.array(rows))
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    if width == 4:
        at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
        return rows, np.frombuffer(column.buffers()[2], np.float32, len(rows) * dim, int(at)).reshape(-1, dim)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    if flat.null_count:
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(1)
        rows, x = rows[whole], x[whole]
    return rows, x


def _cosines(x: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Of rows with a unit vector, rounded; -inf for rows that can't be compared."""
    x = x.astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        n = np.linalg.norm(x, axis=1)
        good = np.isfinite(n) & (n > MIN_NORM)
        return np.where(good, np.round((x @ unit) / np.where(good, n, 1), PLACES), -np.inf)


def _nearest(batches: Iterator[pa.RecordBatch], unit: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task, with their similarity."""
    single, kept = unit.astype(np.float32), None
    error = 4 * len(unit) * float(np.finfo(np.float32).eps)  # of a cosine in single precision, amply
    for b in batches:
        rows, x = _matrix(b.column("vector"), len(unit))
        if not len(rows):
            continue
        with np.errstate(invalid="ignore", over="ignore"):
            rough = (x @ single) / np.sqrt(np.einsum("ij,ij->i", x, x))
        rough[~np.isfinite(rough)] = 2.0  # what single precision can't tell is computed anew
        if len(rows) > k:
            near = np.flatnonzero(rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 2 * error)
            if (rough == 2.0).any():  # these may push out others
                near = np.flatnonzero(rough >= np.partition(np.where(rough == 2.0, -2.0, rough), len(rows) - k)[len(rows) - k] - 2 * error)
            rows, x = rows[near], x[near]
        s = _cosines(x, unit)
        rows, s = rows[s > -np.inf], s[s > -np.inf]
        part = pa.Table.from_batches([b.take(pa.array(rows))]).append_column("similarity", pa.array(s))
        kept = part if kept is None else pa.concat_tables([kept, part])
        kept = kept.take(pc.sort_indices(kept, [("similarity", "descending"), ("semantic_id", "ascending")])[:k])
    if kept is not None:
        yield from kept.combine_chunks().to_batches()


def search(vectors: DataFrame, query: list[float], k: int, filters: SearchFilters | None = None, dim: int | None = None) -> DataFrame:
    """The k rows of vectors nearest to a query, with similarity; equal ones by semantic_id. Filters come before the product."""
    if dim is not None and len(query) != dim:
        raise ValueError(f"a query of {len(query)} dimensions, vectors of {dim}")
    if k <= 0 or not comparable(query):
        return vectors.withColumn("similarity", F.lit(0.0)).limit(0)
    v = np.asarray(query, float)
    unit = v / np.linalg.norm(v)
    rows = (filters or SearchFilters()).apply(vectors)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", similarity double"
    return rows.mapInArrow(lambda it: _nearest(it, unit, k), schema).orderBy(F.desc("similarity"), "semantic_id").limit(k)


def _units(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be compared, their unit vectors)."""
    rows, x = _matrix(column, dim)
    x = x.astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        n = np.linalg.norm(x, axis=1)
    good = np.isfinite(n) & (n > MIN_NORM)
    return rows[good], x[good] / n[good, None]


class _Best:
    """The k best (similarity, line) so far of each of some queries, given as unit vectors; equal similarities by line."""

    def __init__(self, units: np.ndarray, k: int):
        self.units, self.k, self.least = units, k, np.full(len(units), -np.inf)
        self.single = units.astype(np.float32)
        self.error = 4 * units.shape[1] * float(np.finfo(np.float32).eps)  # of a cosine in single precision, amply
        self.step = max(1, min(BLOCK, (1 << 23) // max(1, len(units))))  # 32 MB of scores at a time
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def meet(self, x: np.ndarray, line: np.ndarray) -> None:
        """x: unit vectors, whose ids are line."""
        for at in range(0, len(x), self.step):
            self._meet(x[at : at + self.step], line[at : at + self.step])

    def _meet(self, x: np.ndarray, line: np.ndarray) -> None:
        rough = self.single @ x.astype(np.float32).T
        least = self.least - self.error
        if (new := np.isinf(least)).any():  # as yet fewer than k: the best k of these
            n = min(self.k, len(line))
            least[new] = np.partition(rough[new], len(line) - n, axis=1)[:, len(line) - n] - 2 * self.error
        q, c = np.nonzero(rough >= least.astype(np.float32)[:, None] - np.float32(self.error))
        for at in range(0, len(q), 1 << 16):
            some, there = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
            s = np.round(np.einsum("ij,ij->i", self.units[some], x[there]), PLACES)
            good = s >= self.least[some]
            self.held.append((some[good], s[good], line[there[good]]))
            self.size += int(good.sum())
        if self.size > 4_000_000 or self.size > 2 * self.k * len(self.units):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, line = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        o = np.lexsort((line, -s, q))
        q, s, line = q[o], s[o], line[o]
        first = np.searchsorted(q, np.arange(len(self.least)))
        place = np.arange(len(q)) - first[q]
        self.least[q[place == self.k - 1]] = s[place == self.k - 1]
        keep = place < self.k
        self.held, self.size = [(q[keep], s[keep], line[keep])], int(keep.sum())
        return self.held[0]

    def rows(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, s, line = self.cut()
        for at in range(0, len(q), 1 << 18):
            i = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[q[i]], pa.int64()), "line_id": pa.array(line[i], pa.int64()), "similarity": pa.array(s[i])})


def _beside(batches: Iterator[pa.RecordBatch], ids: np.ndarray, units: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of a task for every query."""
    if not len(ids):
        return
    best = _Best(units, k)
    for b in batches:
        rows, x = _units(b.column("vector"), units.shape[1])
        best.meet(x, b.column("line_id").to_numpy(zero_copy_only=False)[rows])
    yield from best.rows(ids)


def _packed(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, vector) that can be compared as a row for each block and `rows` of them: block, ids, and the bytes of their matrix."""
    for b in batches:
        block = b.column("block").to_numpy(zero_copy_only=False)
        some, x = _matrix(b.column("vector"), dim)
        ids = b.column("id").to_numpy(zero_copy_only=False)[some]
        block = block[some]
        for n in np.unique(block):
            own = np.flatnonzero(block == n)
            for at in range(0, len(own), rows):
                i = own[at : at + rows]
                yield pa.RecordBatch.from_pydict({"block": pa.array([n], pa.int32()), "ids": pa.array([ids[i].astype("<i8").tobytes()], pa.binary()), "data": pa.array([x[i].tobytes()], pa.binary())})


def _past(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Packed rows by block, a block's queries (side 0) before the vectors: the best k of every query."""

    def unit(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b.column("data")[i].as_buffer(), np.float64 if b.column("wide")[i].as_py() else np.float32).reshape(-1, dim).astype(float)
        with np.errstate(invalid="ignore", over="ignore"):
            n = np.linalg.norm(x, axis=1)
        good = np.isfinite(n) & (n > MIN_NORM)
        return np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)[good], x[good] / n[good, None]

    at, queries, best = None, [], None
    for b in batches:
        for i in range(b.num_rows):
            block = b.column("block")[i].as_py()
            if block != at:
                if best is not None:
                    yield from best.rows(ids)
                at, queries, best = block, [], None
            some, x = unit(b, i)
            if b.column("side")[i].as_py() == 0:
                queries.append((some, x))
            elif queries:
                if best is None:
                    ids, units = map(np.concatenate, zip(*queries))
                    best = _Best(units, k)
                best.meet(x, some)
    if best is not None:
        yield from best.rows(ids)


def search_all(vectors: DataFrame, queries: DataFrame, k: int, filters: SearchFilters | None = None) -> DataFrame:
    """query_id, line_id, similarity (the cosine) and rank of the k lines nearest to each row of queries (query_id, vector).

    vectors: line_id and vector, and what filters need. The dimension is the one most queries have; the lesser of two that are
    equally frequent. Equal similarities are ranked by line_id."""
    rows = (filters or SearchFilters()).apply(vectors).select("line_id", "vector")
    q = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    found = "query_id bigint, line_id bigint, similarity double"
    bytes_ = dict(q.dtypes)["vector"] == "binary"
    length = (F.octet_length("vector") / 4).cast("int") if bytes_ else F.size("vector")
    dims = q.groupBy(length.alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").orderBy(F.desc("n"), "dim").first()
    if dims is None or k <= 0:
        return queries.sparkSession.createDataFrame([], found + ", rank int")
    if dims.n * dims.dim * 8 <= BROADCAST_BYTES and dims.n * k * 24 <= BROADCAST_BYTES:
        got = q.where(length == dims.dim).toArrow().combine_chunks()
        some, units = _units(got.column("vector").combine_chunks(), dims.dim)
        sent = vectors.sparkSession.sparkContext.broadcast((got.column("query_id").to_numpy()[some], units))
        best = rows.mapInArrow(lambda it: _beside(it, *sent.value, k), found)
    else:
        # as many blocks as keep all cores busy; more only if they would be too large, since every vector goes to each of them
        blocks = max(-(-dims.n // QUERY_BLOCK), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-dims.n // 256)))
        packed = "block int, ids binary, data binary"

        def sided(df: DataFrame, side: int, key: str) -> DataFrame:
            wide = "array<double>" in dict(df.dtypes)["vector"]
            if side == 0:  # dealt before they are packed, so that a block's queries are in few rows
                df = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("id"), "vector")
                df = df.mapInArrow(lambda it: _packed(it, dims.dim, QUERY_BLOCK), packed)
            else:
                df = df.select(F.lit(0).alias("block"), F.col(key).alias("id"), "vector").mapInArrow(lambda it: _packed(it, dims.dim, BLOCK), packed)
                df = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            return df.select("block", F.lit(side).alias("side"), F.lit(wide).alias("wide"), "ids", "data")

        both = sided(q, 0, "query_id").unionByName(sided(rows, 1, "line_id"))
        best = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side").mapInArrow(lambda it: _past(it, dims.dim, k), found)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "line_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
