"""Intermediate tables in the folder that all executors share, and exact global positions.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import shared_dir


ROWS_PER_FILE = 100_000  # of narrow rows


class Workspace:
    """A folder of one run; tables are written with Spark's commit protocol."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write df and return it reread, with the schema it had.

        rows: what it holds at most, so that few rows don't become a file in each partition.
        """
        path = f"{self.root}/{name}"
        if rows is not None and rows < partitions(self.spark) * ROWS_PER_FILE:
            df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """Write df, delete every other table of this folder, and return df reread."""
        out = self.save(df, "result")
        self.drop(*(n for n in self.names() if n != "result"))
        return out

    def names(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return [f.getPath().getName() for f in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]

    def drop(self, *names: str) -> None:
        """Delete these tables; the name '' stands for the whole folder."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(ws: Workspace, df: DataFrame, keys: list, name: str, amounts: tuple[str, ...] = ()) -> DataFrame:
    """df with ``pos``, the row's exact place from 0 in the order of keys, and for each
    amount ``before_<amount>``, its sum over all rows before.

    Rows are range-partitioned and sorted, each task counts its own rows, and one row
    per partition reaches the driver. No group of rows meets in one task, however
    often a leading key repeats, as long as keys together are distinct. Null amounts
    count as 0.
    """
    import numpy as np

    held = ["_row", *(f"_sum_{a}" for a in amounts)]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), *(T.StructField(h, T.LongType()) for h in held)])
    places = [df.columns.index(a) for a in amounts]

    def count(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), [0] * len(held)
        for b in batches:
            own = [np.ones(b.num_rows, np.int64), *(b.column(i).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for i in places)]
            ends = [np.cumsum(x) for x in own]
            extra = [pa.array(e - x + t, pa.int64()) for e, x, t in zip(ends, own, total, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), *extra], names=schema.names)
            if b.num_rows:
                total = [t + int(e[-1]) for t, e in zip(total, ends, strict=True)]

    rows = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = ws.save(rows.mapInArrow(tidy(count), schema), name)
    out = rows.join(F.broadcast(bases(rows, dict(zip(held, [F.lit(1), *map(F.col, amounts)], strict=True)))), "_part")
    out = out.withColumn("pos", F.col("_row") + F.col("_base_row"))
    for a in amounts:
        out = out.withColumn(f"before_{a}", F.col(f"_sum_{a}") + F.col(f"_base_sum_{a}"))
    return out.drop("_part", *held, *(f"_base{h}" for h in held))


def bases(rows: DataFrame, amounts: dict) -> DataFrame:
    """(_part, _base<name>...): the sums over all partitions before this one.

    One row per partition reaches the driver, so what is collected and broadcast is
    bounded by the number of partitions.
    """
    names = list(amounts)
    sums = sorted(tuple(r) for r in rows.groupBy("_part").agg(*(F.coalesce(F.sum(amounts[n]), F.lit(0)).cast("long").alias(n) for n in names)).collect())
    out, total = [], [0] * len(names)
    for part, *own in sums:
        out.append((part, *total))
        total = [t + n for t, n in zip(total, own, strict=True)]
    return rows.sparkSession.createDataFrame(out, "_part int" + "".join(f", _base{n} long" for n in names))


def text_buffers(column: pa.Array) -> tuple:
    """(bytes as uint8, offsets as int64) of a string array; null is the empty text."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(offs, most: int = 1 << 20):
    """Runs (i, j) of texts that hold about `most` bytes together, at least one text each."""
    import numpy as np

    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def release() -> None:
    """Hand freed memory back: Python workers live on between tasks, and two share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """A function of Arrow batches that hands memory back once its task has ended."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m"):
    """Texts can be long, so fewer bytes of them cross to Python at once; the session is left as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def portions(batches, column: int | str, most: int = 1 << 21):
    """The batches cut so that each holds about `most` bytes of a text column, at least one row."""
    for batch in batches:
        for i, j in slices(text_buffers(batch.column(column))[1], most):
            yield batch.slice(i, j - i)
