"""Spark session settings used by tests, the bench and examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 4, shuffle_partitions: int = 8, memory: str = "6g", app: str = "quillspan") -> SparkSession:
    """A local session with UTC time, adaptive execution and no UI."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
