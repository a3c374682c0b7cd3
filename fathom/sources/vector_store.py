"""The vector table: Parquet under versioned folders, with one pointer that says which version counts.

A write makes a new version and then moves the pointer by renaming a file, so a reader sees the old table or the new one, and a
lost writer leaves the old one. One writer at a time.
"""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, reject_reason
from ..operators.filters import SearchFilters
from ..operators.vector_search import search


class VectorReader(Protocol):
    def read(self) -> DataFrame: ...

    def search(self, query: list[float], k: int, filters: SearchFilters | None = None) -> DataFrame: ...


class VectorWriter(VectorReader, Protocol):
    def insert_batch(self, records: DataFrame) -> int: ...

    def remove_by_book(self, key: str) -> int: ...

    def clear(self) -> int: ...


class StoreError(ValueError):
    pass


class ReadOnlyError(PermissionError):
    """A mutator was called on a read-only index."""


def upserted(old: DataFrame, new: DataFrame, key: str = "semantic_id") -> DataFrame:
    """old with the rows of new, which replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def last_of_each(records: DataFrame, key: str = "semantic_id") -> DataFrame:
    """Of rows with the same key the last in the order of records."""
    rows = records.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_order"))
    return rows.groupBy(F.col(f"_row.{key}").alias("_key")).agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")


def removed(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """vectors without those of the books named."""
    return vectors.where(~F.coalesce(F.col("source_book_key").isin(keys), F.lit(False)))


class VectorStore:
    """Records (metadata and vector) of one dimension, in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, dim: int, schema: str):
        self.spark, self.path, self.dim, self.schema = spark, path.rstrip("/"), dim, schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> str | None:
        p = self._path(f"{self.path}/CURRENT")
        for candidate in (p, self._path(f"{self.path}/CURRENT.old")):  # a writer lost between its two renames
            if self._fs.exists(candidate):
                return self.spark.read.text(candidate.toString()).first()[0]
        return None

    def read(self) -> DataFrame:
        at = self._pointer()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        version, old = f"v-{uuid.uuid4().hex}", self._pointer()
        df.write.parquet(f"{self.path}/{version}")
        out = self._fs.create(self._path(f"{self.path}/CURRENT.new"), True)
        out.write(bytearray(version.encode()))
        out.close()
        current, parked = self._path(f"{self.path}/CURRENT"), self._path(f"{self.path}/CURRENT.old")
        if self._fs.exists(current):
            self._fs.delete(parked, False)
            self._fs.rename(current, parked)
        if not self._fs.rename(self._path(f"{self.path}/CURRENT.new"), current):
            raise StoreError("the new version could not be installed")
        self._fs.delete(parked, False)
        if old:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)

    def insert_batch(self, records: DataFrame) -> int:
        """Adds or replaces by semantic_id, all or nothing; vectors are stored with unit length."""
        bad = records.select("semantic_id", reject_reason(F.col("vector"), self.dim).alias("reason")).where(F.col("reason").isNotNull()).orderBy("semantic_id").limit(1).collect()
        if bad:
            raise StoreError(f"{bad[0].semantic_id}: {bad[0].reason}")
        new = last_of_each(records).withColumn("vector", l2_normalize(F.col("vector")))
        n = new.count()
        if n:
            self._write(upserted(self.read(), new.select(self.read().columns)))
        return n

    def remove_by_book(self, key: str) -> int:
        return self.remove_books([key])

    def remove_books(self, keys: list[str]) -> int:
        df = self.read()
        n = df.where(F.col("source_book_key").isin(keys)).count()
        if n:
            self._write(removed(df, keys))
        return n

    def clear(self) -> int:
        n = self.read().count()
        if n:
            self._write(self.read().limit(0))
        return n

    def count(self) -> int:
        return self.read().count()

    def book_keys(self) -> DataFrame:
        return self.read().select("source_book_key").distinct().orderBy("source_book_key")

    def book_vector_count(self, key: str) -> int:
        return self.read().where(F.col("source_book_key") == key).count()

    def contains(self, semantic_id: str) -> bool:
        return bool(self.read().where(F.col("semantic_id") == semantic_id).limit(1).count())

    def search(self, query: list[float], k: int, filters: SearchFilters | None = None) -> DataFrame:
        return search(self.read(), query, k, filters, self.dim)


class ReadOnlyStore:
    """A reader; every mutator is refused by name."""

    def __init__(self, store: VectorStore):
        self._store = store

    def __getattr__(self, name: str):
        if name in ("insert_batch", "remove_by_book", "remove_books", "clear"):
            raise ReadOnlyError(name)
        return getattr(self._store, name)
