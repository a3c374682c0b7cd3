"""The corpus pipeline: toxic documents go, then exact copies, near copies and repeated passages; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents; the last returns the packed pieces.

A row with a null text, or a null id and no copy, is kept by every stage that filters, and has nothing to pack; so has an empty
text. Repeated rows are copies: one stays. No documents give no rows. Further columns of documents are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import exact, packing, simhash, suffix, toxicity
from fathom.llm.durable import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: SQL can express neither the first nor the third and later stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = table(docs, "stage")
            if held is not None:
                held.drop()
            held, docs = written, written.df
    return docs
