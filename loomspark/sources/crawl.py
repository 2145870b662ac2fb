"""Pages by a range of ids: a stream whose offsets are ids, each asked for by whichever task has it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.retries import drained, retried


def id_stream(spark: SparkSession, first: int, last: int, per_batch: int = 10_000, partitions: int = 8) -> DataFrame:
    """(at, id) of the ids from first to last, so many a batch. A stream that goes on from a checkpoint begins behind what it had."""
    # times begin a day after the epoch, as a watermark begins at it and leaves out what isn't later
    rows = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=per_batch, numPartitions=partitions, startTimestamp=86_400_000).load()
    return rows.select(F.col("timestamp").alias("at"), (F.col("value") + first).alias("id")).where(F.col("id") <= last)


def crawl(spark: SparkSession, fetch: Callable, first: int, last: int, out: str, checkpoint: str, per_batch: int = 10_000, attempts: int = 3, delay: float = 1.0, lanes: int = 64, patience: float = 3600.0) -> DataFrame:
    """(id, body, attempts, error) of every id from first to last, once: body null and no error where there is no page.

    fetch: a function of an id to a body, or None if there is no page; what it raises is tried again after a
    growing delay, by a timer and not in a waiting task. Ids that fail to the last are rows with an error,
    to be taken again. A crawl that was stopped, here by its patience, goes on from its checkpoint and asks
    for no id again that has its answer.
    """

    def provider(ids: list[str], tries: list[int]) -> list:
        return [_caught(fetch, int(i), t) for i, t in zip(ids, tries, strict=True)]

    ids = id_stream(spark, first, last, per_batch).withColumn("prompt", F.col("id").cast("string"))
    stream = retried(ids, "id", "prompt", "at", provider, attempts, delay, lanes=lanes, most=100)
    past = lambda progress: int((re.search(r"offset\D+(\d+)", str(progress["sources"][0]["endOffset"])) or "00")[1]) > last - first
    answers = drained(stream, out, checkpoint, trigger="500 milliseconds", patience=patience, over=past)
    return answers.select(F.col("id").cast("long").alias("id"), F.col("reply").alias("body"), "attempts", "error")


def _caught(fetch: Callable, page: int, attempt: int):
    try:
        return fetch(page, attempt)
    except Exception as e:
        return e
