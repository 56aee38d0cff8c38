"""Transcripts as a stream: each micro-batch of new or changed files is an import pass of its own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators.sequences import GAP, failure_repairs, prepared
from quillspan.sources import session_lines
from quillspan.sources.transcripts import file_touches, session_table, steps
from quillspan.tables import snapshot


def file_stream(spark: SparkSession, path: str, glob: str = "*.jsonl", files_per_batch: int = 1000) -> DataFrame:
    """(file) of files as they arrive, no bytes of them; a file that was written anew arrives again."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = reader.options(recursiveFileLookup=True, pathGlobFilter=glob, maxFilesPerTrigger=files_per_batch).load(path)
    return found.select(F.col("path").alias("file"))


def start_import(spark: SparkSession, path: str, layout: str, out: str, checkpoint: str, root: str | None = None, once: bool = False, **options) -> StreamingQuery:
    """Starts writing events, headers and touches of arriving transcripts below out, a folder for each batch.

    A batch that is tried again overwrites its own folder, so each is there exactly once. With `once` the query ends
    when all files that are there have been read.
    """

    def keep(batch: DataFrame, number: int) -> None:
        names = [r["file"] for r in batch.select("file").distinct().collect()]  # files_per_batch at most
        if not names:
            return
        lines = session_lines.numbered(spark, paths=json.dumps(names))
        at = {name: f"{out}/{name}/batch={number}" for name in ("events", "headers", "touches")}
        events, headers = session_table(snapshot(steps(lines, layout), "steps"), root)
        events.write.mode("overwrite").parquet(at["events"])
        headers.write.mode("overwrite").parquet(at["headers"])
        file_touches(spark.read.parquet(at["events"])).write.mode("overwrite").parquet(at["touches"])

    writer = file_stream(spark, path, **options).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def imported(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The imported table: of a session that arrived several times, the rows of its last batch."""
    rows = spark.read.parquet(f"{out}/{name}")
    last = rows.groupBy("trajectory_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["trajectory_id", "batch"], "left_semi").drop("batch")


def repairs_of(spark: SparkSession, out: str, gap: int = GAP) -> DataFrame:
    """Failure repairs of what has been imported so far."""
    return failure_repairs(prepared(imported(spark, out, "events"), gap, detectors=("failure_repair",)))


def activity(events: DataFrame, every: str = "10 minutes", late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """Counts of a stream's (or table's) events by window and type; events more than `late` behind the latest are dropped by a stream."""
    stamped = events.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late)
    by = stamped.groupBy(F.window("_at", every).alias("w"), "type").agg(F.count("*").alias("events"))
    return by.select(F.col("w.start").alias("window_start"), "type", "events")
