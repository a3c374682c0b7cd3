"""What has to be indexed: the library against the manifest, and the totals of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, UNVERIFIABLE, UP_TO_DATE, REMOVED = "new", "changed", "unverifiable", "up_to_date", "removed"
CANONICAL, CONTENT_ONLY, NO_FINGERPRINT = "canonical", "content_only", "unverifiable"
INDEXED, SKIPPED, EMPTY = "indexed", "skipped", "empty"


def fingerprint_kind(raw: Column) -> Column:
    """Of a raw lexical hash: 0 says that there is none."""
    return F.when(raw == 0, NO_FINGERPRINT).otherwise(CANONICAL)


def index_diff(library: DataFrame, manifest: DataFrame, chunking_identity: int, normalization_version: int, full_rebuild: bool = False) -> DataFrame:
    """source_book_key and need. library: source_book_key, kind, hash; manifest: source_book_key, content_hash, chunking_identity,
    normalization_version. An entry of other versions is changed; then one without a hash is unverifiable; a hash of content
    alone that agrees says nothing about titles and facets. In a full rebuild known books are changed, others new."""
    lib = library.select("source_book_key", "kind", "hash", F.lit(True).alias("_lib"))
    man = manifest.select("source_book_key", "content_hash", "chunking_identity", "normalization_version", F.lit(True).alias("_man"))
    both = lib.join(man, "source_book_key", "full_outer")
    other = (F.col("chunking_identity") != chunking_identity) | (F.col("normalization_version") != normalization_version)
    same = F.col("content_hash") == F.col("hash")
    known = F.col("_man").isNotNull()
    need = F.when(F.col("_lib").isNull(), REMOVED).when(~known, NEW)
    if full_rebuild:
        return both.select("source_book_key", need.otherwise(CHANGED).alias("need"))
    need = need.when(other, CHANGED).when((F.col("content_hash") == 0) | (F.col("kind") == NO_FINGERPRINT), UNVERIFIABLE)
    return both.select("source_book_key", need.when(~same, CHANGED).when(F.col("kind") == CONTENT_ONLY, UNVERIFIABLE).otherwise(UP_TO_DATE).alias("need"))


def is_current(computed: DataFrame, manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """source_book_key and current: all six of a book's line fingerprint, content hash, number of chunks, chunking identity, version of
    normalisation and number of stored vectors agree. computed and manifest have the first five, counts (vectors) the last."""
    fields = "line_fingerprint", "content_hash", "chunk_count", "chunking_identity", "normalization_version"
    m = manifest.select("source_book_key", *[F.col(f).alias(f"m_{f}") for f in fields])
    both = computed.join(m, "source_book_key", "left").join(counts.select("source_book_key", "vectors"), "source_book_key", "left")
    same = F.coalesce(F.col("vectors"), F.lit(0)) == F.col("chunk_count")
    for f in fields:
        same = same & (F.col(f) == F.col(f"m_{f}"))
    return both.select("source_book_key", F.coalesce(same, F.lit(False)).alias("current"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("book_count"), F.count(F.when(F.col("chunk_count") == 0, 1)).alias("empty_book_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("total_chunk_count"))


def indexing_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of (source_book_key, outcome, chunks)."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return outcomes.agg(n(INDEXED).alias("indexed_books"), n(SKIPPED).alias("skipped_books"), n(EMPTY).alias("empty_books"), F.coalesce(F.sum(F.when(F.col("outcome") == INDEXED, F.col("chunks"))), F.lit(0)).cast("bigint").alias("indexed_chunks"))


def book_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("source_book_key").agg(F.count("*").alias("vectors"))


def vectors_against_manifest(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: vectors and books in the store and in the manifest, and whether they agree."""
    a = vectors.agg(F.count("*").alias("stored_vectors"), F.count_distinct("source_book_key").alias("stored_books"))
    b = manifest.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("manifest_vectors"), F.count(F.when(F.col("chunk_count") > 0, 1)).alias("manifest_books"))
    return a.crossJoin(b).withColumn("agree", (F.col("stored_vectors") == F.col("manifest_vectors")) & (F.col("stored_books") == F.col("manifest_books")))


def book_index_differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(source_book_key, semantic_id) pairs that only one of two book indexes has."""
    cols = "source_book_key", "semantic_id"
    a, b = stored.select(*cols), rebuilt.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("rebuilt")))
