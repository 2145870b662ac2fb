"""Streaming forms: windows over events, and exactly-once resumable enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, like: str | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with the schema of what is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = spark.readStream.schema(spark.read.parquet(like or path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return rows.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return rows.parquet(path)


def windowed(events: DataFrame, time: str, value: str, *by: str, size: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """(start, *by, n, total) per window; rows later than the watermark are left out in a stream."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(span.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(user, start, end, n): runs of events with no longer gap."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def enrich_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Apply step to each micro-batch and append it; the checkpoint takes the place of a scan of finished ids."""

    def batch(df: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces its own folder, so none is written twice
        step(df).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
