"""Shared helpers: table reading, bounded Arrow batches and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a Python worker gets at once; documents may be long, so a batch stays a few MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts never fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is named on local cores (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spikeloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a small table: written to the shared folder, read from there after."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Shelf:
    """Parquet tables in the shared folder for what is read more than once.

    `put` writes a table and returns it as read back; `drop` deletes tables no longer needed. What a
    result still reads goes when the driver's session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spikeloom-{uuid.uuid4().hex}"

    def place(self, name: str) -> str:
        """Where a table of this name goes, in a folder that is deleted when the session ends."""
        system, root = self._folder(self.root)
        system.mkdirs(root)
        system.deleteOnExit(root)
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.place(name)
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        system, path = self._folder(f"{self.root}/{name}")
        system.delete(path, True)

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path


def keyed(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns under our own names: extra or clashing columns never reach an operator."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in named.items()])
