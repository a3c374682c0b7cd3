"""Vectors against the corpus they claim to describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import semantic_id
from ..functions.vectors import l2_normalize, reject_reason

#: Stored fields that the corpus answers for; chunk_hash is the producer's own and is only checked for its form.
FIELDS = "semantic_id", "source_book_key", "source_doc_key", "line_id", "section_id", "line_hash", "content_hash", "reference", "segment", "is_pdf", "title", "facets"
HEX64, HEX32 = "^[0-9a-f]{64}$", "^[0-9a-f]{32}$"


class PackError(ValueError):
    pass


def input_problems(inputs: DataFrame, corpus: DataFrame, dim: int) -> DataFrame:
    """line_id and problem of every input: dimension, component, norm, malformed_digest, not_in_corpus, text_mismatch, or null."""
    lines = corpus.select("line_id", F.sha2("text", 256).alias("_actual"))
    digests = ~F.col("source_line_sha256").rlike(HEX64) | ~F.col("embedding_text_sha256").rlike(HEX64)
    problem = (
        F.when(reject_reason(F.col("vector"), dim).isNotNull(), reject_reason(F.col("vector"), dim))
        .when(F.coalesce(digests, F.lit(True)), "malformed_digest")
        .when(F.col("_actual").isNull(), "not_in_corpus")
        .when(F.col("_actual") != F.col("source_line_sha256"), "text_mismatch")
    )
    return inputs.join(lines, "line_id", "left").select("line_id", problem.alias("problem"))


def expected_fields(corpus: DataFrame, chunking_identity: int) -> DataFrame:
    """The record that the corpus gives each line."""
    key, line = F.col("source_book_key"), F.col("line_id")
    return corpus.select(semantic_id(key, line, chunking_identity).alias("semantic_id"), "source_book_key", F.concat_ws(":", key, line.cast("string")).alias("source_doc_key"), "line_id", "section_id", "line_hash", "content_hash", "reference", "segment", "is_pdf", "title", "facets")


def pack_records(inputs: DataFrame, corpus: DataFrame, chunking_identity: int) -> DataFrame:
    """Records for inputs without problems, with unit vectors; chunk_hash is the first half of the digest of the embedded text."""
    own = inputs.select("line_id", F.substring("embedding_text_sha256", 1, 32).alias("chunk_hash"), l2_normalize(F.col("vector")).alias("vector"))
    return expected_fields(corpus, chunking_identity).join(own, "line_id")


def record_problems(records: DataFrame, corpus: DataFrame, chunking_identity: int) -> DataFrame:
    """line_id and problem of every record that disagrees with the corpus: the first field that differs, in the order of FIELDS, or
    not_in_corpus or chunk_hash."""
    e = expected_fields(corpus, chunking_identity).select(*[F.col(f).alias(f"e_{f}") for f in FIELDS])
    both = records.join(e, F.col("line_id") == F.col("e_line_id"), "left")
    text: Column = F.when(F.col("e_line_id").isNull(), "not_in_corpus").when(~F.col("chunk_hash").rlike(HEX32), "chunk_hash")
    for f in FIELDS:
        text = text.when(~F.col(f).eqNullSafe(F.col(f"e_{f}")), f)
    return both.select("line_id", text.alias("problem")).where(F.col("problem").isNotNull())


def coverage(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: how many line_ids are missing and unexpected, and the smallest of each."""
    e, c = expected.select("line_id").distinct(), covered.select("line_id").distinct()
    gap = lambda a, b, n: a.join(b, "line_id", "left_anti").agg(F.count("*").alias(n), F.min("line_id").alias(f"first_{n}"))
    return gap(e, c, "missing").crossJoin(gap(c, e, "unexpected"))


def pack(inputs: DataFrame, corpus: DataFrame, dim: int, chunking_identity: int) -> DataFrame:
    """pack_records, after every check; the first problem by line_id is raised."""
    bad = input_problems(inputs, corpus, dim).where(F.col("problem").isNotNull()).orderBy("line_id").limit(1).collect()
    if bad:
        raise PackError(f"line {bad[0].line_id}: {bad[0].problem}")
    c = coverage(corpus, inputs).first()
    if c.missing or c.unexpected:
        raise PackError(f"coverage: {c.missing} missing (first {c.first_missing}), {c.unexpected} unexpected (first {c.first_unexpected})")
    return pack_records(inputs, corpus, chunking_identity)


def validate(records: DataFrame, corpus: DataFrame, chunking_identity: int) -> None:
    bad = record_problems(records, corpus, chunking_identity).orderBy("line_id").limit(1).collect()
    if bad:
        raise PackError(f"line {bad[0].line_id}: {bad[0].problem} disagrees with the corpus")
