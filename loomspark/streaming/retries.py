"""Calls to an outside service over a stream, with retries that hold no core.

A request that fails goes to the state of its lane with the time at which it is due, and a timer
asks again then; between two tries nothing waits. The state lies in the checkpoint, so a stream that
is stopped, or loses executors, goes on with what was under way and gives every request one answer.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lane(StatefulProcessor):
    """The requests of one lane: their first tries, and later ones when they are due."""

    def __init__(self, provider: Callable, attempts: int, delay: float, growth: float, most: int):
        self.provider, self.attempts, self.delay, self.growth, self.most = provider, attempts, delay, growth, most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id string", "prompt string, tries int, due long")

    def ask(self, requests: list[tuple[str, str, int]], now: int):
        """Answers of these requests (id, prompt, tries so far); those that fail wait, or are given up."""
        out, later, timers = [], [], set()
        for k in range(0, len(requests), self.most):
            part = requests[k : k + self.most]
            try:
                replies = self.provider([p for _, p, _ in part], [t + 1 for *_, t in part])
            except Exception as e:  # the whole call failed
                replies = [e] * len(part)
            for (id_, prompt, tries), reply in zip(part, replies, strict=True):
                if not isinstance(reply, Exception):
                    out.append((id_, reply, tries + 1, None))
                elif tries + 1 >= self.attempts:
                    out.append((id_, None, tries + 1, str(reply)))
                else:
                    later.append((id_, prompt, tries + 1))
        for id_, prompt, tries in later:
            due = now + int(1000 * self.delay * self.growth ** (tries - 1))
            self.waiting.updateValue((id_,), (prompt, tries, due))
            timers.add(due)
        # one timer serves all requests that are due together
        for due in sorted(timers):
            self.handle.registerTimer(due)
        return pd.DataFrame(out, columns=["id", "reply", "attempts", "error"])

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        new = [r for part in rows for r in zip(part["id"], part["prompt"], [0] * len(part), strict=True)]
        if self.waiting.exists():  # else none of them waits
            new = [r for r in new if not self.waiting.containsKey((r[0],))]
        yield self.ask(new, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        due = [(k[0], v[0], v[1]) for k, v in self.waiting.iterator() if v[2] <= now]
        for id_, *_ in due:
            self.waiting.removeKey((id_,))
        yield self.ask(due, now)

    def close(self) -> None:
        pass


def retried(stream: DataFrame, key: str, prompt: str, time: str, provider: Callable, attempts: int = 3, delay: float = 1.0, growth: float = 2.0, lanes: int = 64, most: int = 1000, late: str = "1 hour") -> DataFrame:
    """(id, reply, attempts, error) of each request of a stream, once: its reply, or the last error after so many attempts.

    provider: a function of prompts and their attempts' numbers to replies, with an exception in the place
    of one that failed; if it raises, all of them failed. Requests are dealt to lanes by their key's hash;
    a lane asks for at most so many at a time. Rows later than the watermark are left out, and rows that
    repeat a key within it; null keys are left out, null prompts are empty. The session's state store must
    be the one named in STORE.
    """
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late).where(F.col(key).isNotNull())
    rows = rows.select(F.col("_at").alias("at"), F.col(key).cast("string").alias("id"), F.coalesce(F.col(prompt).cast("string"), F.lit("")).alias("prompt"))
    rows = rows.dropDuplicatesWithinWatermark(["id"]).withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)))
    return rows.groupBy("lane").transformWithStateInPandas(Lane(provider, attempts, delay, growth, most), "id string, reply string, attempts int, error string", "Append", "ProcessingTime")


def drained(stream: DataFrame, out: str, checkpoint: str, trigger: str = "1 second", patience: float = 600.0, over: Callable = lambda progress: progress["numInputRows"] == 0) -> DataFrame:
    """Run a stream of `retried` until what there is has an answer, then stop it; returns the answers so far.

    over: whether a batch's progress shows that the source has no more. A run that finds the checkpoint of
    another goes on where that stopped, as this one does if its patience ends before.
    """
    spark, end = stream.sparkSession, clock.monotonic() + patience
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
        try:
            batch, quiet = -1, 0
            while quiet < 2 and clock.monotonic() < end:
                if run.exception() is not None:
                    raise run.exception()
                seen = run.lastProgress
                if seen and seen["batchId"] > batch:
                    batch = seen["batchId"]
                    waits = sum(o["numRowsTotal"] for o in seen["stateOperators"] if o["operatorName"].startswith("transformWithState"))
                    quiet = quiet + 1 if waits == 0 and over(seen) else 0
                clock.sleep(0.1)
        finally:
            run.stop()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema("id string, reply string, attempts int, error string").parquet(out)
