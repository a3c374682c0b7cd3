"""A snapshot of the vector table: Parquet sorted by semantic_id with a digest for each record, and a header that names both.

The three parts (vectors and metadata in one table here, the header beside it) are written to a staging folder, which then takes
the place of the old one; a writer that is lost between the two renames leaves a parked copy, which opening puts back.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
PRECISION = "f32"


class CorruptedError(ValueError):
    """A snapshot is there in part, or isn't what its header says."""


def digest(df: DataFrame):
    """SHA-256 of a record's metadata and of its vector."""
    meta = [c for c in df.columns if c != "vector"]
    text = F.to_json(F.struct(*meta), {"ignoreNullFields": "false"})
    return F.sha2(text, 256), F.sha2(F.array_join(F.transform("vector", lambda x: F.hex(F.encode(x.cast("string"), "UTF-8"))), ","), 256)


def _whole(df: DataFrame) -> str:
    """A digest of all records, whatever their order: the sum of 60 bits of each one's."""
    part = F.conv(F.substring(F.sha2(F.concat("metadata_sha256", "vector_sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return str(df.agg(F.coalesce(F.sum(part), F.lit(0))).first()[0])


def write(df: DataFrame, path: str, dim: int) -> None:
    """Sorted by semantic_id over ranges, so that files of equal content are written for equal tables."""
    a, b = digest(df)
    rows = df.withColumns({"metadata_sha256": a, "vector_sha256": b})
    staging, parked = f"{path}.new", f"{path}.previous"
    shutil.rmtree(staging, ignore_errors=True)
    rows.repartitionByRange("semantic_id").sortWithinPartitions("semantic_id").write.parquet(f"{staging}/records")
    written = df.sparkSession.read.parquet(f"{staging}/records")
    header = {"format": FORMAT, "precision": PRECISION, "dim": dim, "count": written.count(), "digest": _whole(written)}
    with open(f"{staging}/header.json", "w", encoding="utf-8") as f:
        json.dump(header, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    shutil.rmtree(parked, ignore_errors=True)
    if os.path.exists(path):
        os.rename(path, parked)
    try:
        os.rename(staging, path)
    except OSError:
        if os.path.exists(parked):
            os.rename(parked, path)
        raise
    shutil.rmtree(parked, ignore_errors=True)


def recover(path: str) -> None:
    if not os.path.exists(path) and os.path.exists(f"{path}.previous"):
        os.rename(f"{path}.previous", path)


def read(spark: SparkSession, path: str, dim: int, verify: bool = True) -> DataFrame | None:
    """The snapshot's records; None if there is none at all. verify: all digests are computed anew and compared."""
    recover(path)
    there = [os.path.exists(f"{path}/{x}") for x in ("header.json", "records")]
    if not any(there):
        return None
    if not all(there):
        raise CorruptedError("a part is missing")
    with open(f"{path}/header.json", encoding="utf-8") as f:
        header = json.load(f)
    if header["format"] != FORMAT or header["precision"] != PRECISION or header["dim"] != dim:
        raise CorruptedError(f"the header is of another kind: {header}")
    rows = spark.read.parquet(f"{path}/records")
    if rows.count() != header["count"]:
        raise CorruptedError("the header counts other records")
    plain = rows.drop("metadata_sha256", "vector_sha256")
    if verify:
        a, b = digest(plain)
        bad = rows.where((a != F.col("metadata_sha256")) | (b != F.col("vector_sha256")) | (F.size("vector") != dim)).select("semantic_id").limit(1).collect()
        if bad:
            raise CorruptedError(f"record {bad[0].semantic_id} is damaged")
        if _whole(rows) != header["digest"]:
            raise CorruptedError("records were exchanged")
    return plain
