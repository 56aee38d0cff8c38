"""Snapshots: tables written once in the shared folder and read again, so that later plans start from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder of a local session where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        if where.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspan-"))
            where = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = where.get()
    return path.rstrip("/")


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
