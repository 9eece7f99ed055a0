"""Stored tables that cut a plan in two: written once to shared storage, read by every branch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` (where that is unset: the warehouse) and read again.

    Lost executors cost no recomputation, and what is not deterministic (row numbers, opaque functions) is the same for
    every reader.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    path = f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete what ``stored`` has written."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
