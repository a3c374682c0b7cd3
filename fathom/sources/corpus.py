"""The corpus and the vectors made for it, as files: JSON lines, and raw little-endian float32 beside JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = "line_id bigint, source_book_key string, title string, reference string, section_id bigint, segment bigint, is_pdf boolean, line_hash bigint, content_hash bigint, facets array<string>, text string"
INPUT_SCHEMA = "line_id bigint, source_line_sha256 string, embedding_text_sha256 string"


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class CorpusIdentity:
    corpus_id: str
    library_version: str
    lexical_schema_version: int
    document_id_scheme_version: int


class CorpusIndex(Protocol):
    def identity(self) -> CorpusIdentity: ...

    def lines(self) -> DataFrame: ...

    def expected_line_ids(self) -> DataFrame: ...

    def line(self, line_id: int) -> DataFrame: ...


class JsonCorpus:
    """An identity file and a file, or folder, of JSON lines. Blank lines are skipped; no line and a repeated line_id are errors."""

    def __init__(self, spark: SparkSession, identity_path: str, lines_path: str):
        with open(identity_path, encoding="utf-8") as f:
            self._identity = CorpusIdentity(**json.load(f))
        self._lines = spark.read.schema(CORPUS_SCHEMA).option("mode", "FAILFAST").json(lines_path)
        twice = self._lines.groupBy("line_id").agg(F.count("*").alias("n"))
        seen = twice.agg(F.sum("n").alias("lines"), F.min(F.when(F.col("n") > 1, F.col("line_id"))).alias("repeated")).first()
        if not seen.lines:
            raise SourceError("the corpus has no line")
        if seen.repeated is not None:
            raise SourceError(f"line {seen.repeated} is there more than once")

    def identity(self) -> CorpusIdentity:
        return self._identity

    def lines(self) -> DataFrame:
        return self._lines

    def expected_line_ids(self) -> DataFrame:
        return self._lines.select("line_id")

    def line(self, line_id: int) -> DataFrame:
        return self._lines.where(F.col("line_id") == line_id)


def write_corpus(lines: DataFrame, identity: CorpusIdentity, identity_path: str, lines_path: str) -> None:
    with open(identity_path, "w", encoding="utf-8") as f:
        json.dump(asdict(identity), f)
    lines.write.json(lines_path)


def raw_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """position and vector of a raw float32 file, read in parallel."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size % (4 * dim):
        raise SourceError(f"{size} bytes are no whole number of vectors of {dim} dimensions")
    n = size // (4 * dim)
    # records of fixed length are cut by the input format, so the file is read in parallel; the index is the position
    records = spark.sparkContext.binaryRecords(path, 4 * dim) if n else spark.sparkContext.parallelize([])
    rows = records.zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    raw = spark.createDataFrame(rows, "position bigint, raw binary")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"position": b["position"], "vector": [np.frombuffer(x, "<f4") for x in b["raw"]]})

    return raw.mapInPandas(decode, "position bigint, vector array<float>")


def read_vector_inputs(spark: SparkSession, vectors_path: str, records_path: str, dim: int) -> DataFrame:
    """Records and vectors by position: the k-th line that isn't blank has the k-th vector. Different numbers are an error."""
    lines = spark.read.text(records_path).where(F.trim("value") != "")
    parsed = lines.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    records = spark.createDataFrame(parsed, "position bigint, value string").select("position", F.from_json("value", INPUT_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("position", "r.*")
    vectors = raw_vectors(spark, vectors_path, dim)
    a, b = records.count(), vectors.count()
    if a != b:
        raise SourceError(f"{a} records and {b} vectors")
    return records.join(vectors, "position").drop("position")
