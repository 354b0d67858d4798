"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="marlstone-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Rows and bytes of an Arrow batch: workers hold a few copies of one, and texts are long.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to ``BATCH_LIMITS``; lower ones stay."""
    for key, most in BATCH_LIMITS.items():
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables written under one fresh folder; dropped early by ``drop`` or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back: cuts lineage, and survives lost executors."""
        at = self.path(name)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        at = getattr(df, "_scratch_path", None)
        if at:
            self._fs.delete(self._path(at), True)

    def bytes_of(self, df: DataFrame) -> int:
        """Stored bytes of a table written here."""
        return self._fs.getContentSummary(self._path(df._scratch_path)).getLength()


def empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).head(1)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
