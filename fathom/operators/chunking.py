"""One chunk for each embeddable line; short lines borrow their neighbours' text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facets import all_facets
from ..functions.hashing import ChunkerConfig, chunk_hash, semantic_id
from ..functions.text import truncate_chars, unicode_trim


def with_context(lines: DataFrame, neighbours: int) -> DataFrame:
    """lines with context: the texts of a line and of up to `neighbours` lines on either side in the same run of one section."""
    by_book = Window.partitionBy("source_book_key").orderBy("ord")
    moved = F.coalesce(F.col("section_id") != F.lag("section_id").over(by_book), F.lit(True)).cast("int")
    run = Window.partitionBy("source_book_key", "_run").orderBy("ord").rowsBetween(-neighbours, neighbours)
    return lines.withColumn("_moved", moved).withColumn("_run", F.sum("_moved").over(by_book)).withColumn("context", F.array_join(F.collect_list("text").over(run), " ")).drop("_moved", "_run")


def chunk_lines(books: DataFrame, lines: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """The chunks of all books: books (source_book_key, title, content_fingerprint, is_pdf, topics, extra_facets) and their lines
    (source_book_key, ord, line_id, section_id, text, line_hash, reference, segment). One sort by book and line for the context."""
    n = F.char_length(unicode_trim("text"))
    chosen = with_context(lines.withColumn("text", F.coalesce("text", F.lit(""))), config.context_window_lines).where(n >= config.min_embeddable_chars)
    text = truncate_chars(unicode_trim(F.when(n < config.min_meaningful_chars, F.col("context")).otherwise(F.col("text"))), config.max_chunk_chars)
    chunks = chosen.withColumn("embedding_text", text).where(unicode_trim("embedding_text") != "")
    b = books.select("source_book_key", "title", F.col("content_fingerprint").alias("content_hash"), "is_pdf", all_facets(F.col("topics"), F.col("extra_facets")).alias("facets"))
    return chunks.join(b, "source_book_key").select(
        semantic_id(F.col("source_book_key"), F.col("line_id"), config.identity).alias("semantic_id"),
        "source_book_key",
        F.concat_ws(":", "source_book_key", F.col("line_id").cast("string")).alias("source_doc_key"),
        "line_id",
        "section_id",
        "line_hash",
        F.col("text").alias("anchor_text"),
        "embedding_text",
        chunk_hash(F.col("embedding_text")).alias("chunk_hash"),
        "content_hash",
        "reference",
        "segment",
        "is_pdf",
        "title",
        "facets",
    )


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks without their texts: what is stored with a vector."""
    return chunks.drop("anchor_text", "embedding_text")
