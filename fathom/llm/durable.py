"""Tables that outlive an executor: Parquet in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of our own only where the setting is absent and all is one machine, as in tests.
    On a cluster without the setting nothing can be written that every executor would find: that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fathom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Table:
    """A written table: its DataFrame, its size in bytes, and drop() for when nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{folder(self.spark).rstrip('/')}/fathom-{label}-{uuid.uuid4().hex}"
        atexit.register(self._expire)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    @property
    def bytes(self) -> int:
        fs, p = _fs(self.spark, self.path)
        return fs.getContentSummary(p).getLength()

    def drop(self) -> None:
        atexit.unregister(self._expire)
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)

    def _expire(self) -> None:
        """A table that a result still reads is dropped when the driver ends."""
        try:
            self.drop()
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def table(df: DataFrame, label: str) -> Table:
    return Table(df, label)
