"""Tables between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """The table as written to the checkpoint folder, which all executors share, and read from there:
    its lineage ends, a lost executor loses nothing, and its size is known from its files. (A checkpoint
    keeps the estimated size of its plan; over a chain of joins that estimate is a product of products, so
    that no side is ever taken for small, and in a long loop planning itself becomes slow.) Files go when
    the session ends."""
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    path = f"{root}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
