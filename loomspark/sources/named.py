"""Files with names: tables that end as one file, or one for each key, for readers that know nothing of folders.

All tasks write parts, with Spark's commit protocol, to a folder beside the target. Then the parts are
moved, or joined in order as a stream that the driver holds a buffer of, under a hidden name that is
renamed last. A write that fails leaves nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_name

PART_ROWS = 1_000_000  # of a key, that one task writes


def _fs(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def parts(spark, folder: str) -> list[str]:
    """The folder's part files that hold anything, in the order of their tasks."""
    fs, at = _fs(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen() > 0)


def join(spark, files: list[str], path: str, begin: bytes = b"", between: bytes = b"", end: bytes = b"") -> None:
    """These files' bytes as one file, whole or not at all."""
    fs, at = _fs(spark, path)
    if len(files) == 1 and not begin + end:
        fs.mkdirs(at.getParent())
        fs.rename(_fs(spark, files[0])[1], at)
        return
    fs.mkdirs(at.getParent())
    hidden = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    try:
        out = fs.create(hidden, True)
        try:
            out.write(bytearray(begin))
            for k, name in enumerate(files):
                if k:
                    out.write(bytearray(between))
                own, place = _fs(spark, name)
                held = own.open(place)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
                finally:
                    held.close()
            out.write(bytearray(end))
        finally:
            out.close()
        if not fs.rename(hidden, at):
            raise OSError(f"can't name {path}")
    finally:
        fs.delete(hidden, False)


def vacant(spark, path: str, mode: str) -> None:
    """Make room at path, where the mode is to overwrite; else what is there is an error."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        if mode != "overwrite":
            raise FileExistsError(path)
        fs.delete(at, True)


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"


def one_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The table as one JSON array in one file, a row a line; nulls are left out of their rows. An empty table is []."""
    spark, folder = df.sparkSession, _beside(path)
    # rows of a partition count from 0 in the low bits, so each part but for its first row begins its lines with a comma
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows = df.select(F.to_json(F.struct("*")).alias("j")).select(F.when(first, F.col("j")).otherwise(F.concat(F.lit(","), "j")).alias("value"))
    try:
        rows.write.option("maxRecordsPerFile", 0).text(folder)
        vacant(spark, path, mode)
        join(spark, parts(spark, folder), path, b"[\n", b",", b"]\n")
    finally:
        fs, at = _fs(spark, folder)
        fs.delete(at, True)


def file_per_key(df: DataFrame, key: str, folder: str, ending: str = "jsonl", mode: str = "overwrite") -> None:
    """folder/<key>.<ending> for each key, its name made safe: JSON lines of its rows, without the key.

    A key of more than PART_ROWS rows is written by several tasks, whose parts are joined; others' files
    are only renamed. Keys whose names fall together share a file. Null keys go to `null`.
    """
    spark, beside = df.sparkSession, _beside(folder)
    name = F.coalesce(F.nullif(safe_name(key), F.lit("")), F.lit("null"))
    rows = df.select(name.alias("_name"), F.to_json(F.struct(*(c for c in df.columns if c != key))).alias("value"), F.xxhash64(*(c for c in df.columns)).alias("_h"))
    sizes = rows.groupBy("_name").agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    dealt = rows.join(sizes, "_name").withColumn("_part", F.pmod("_h", "_parts")).repartition("_name", "_part")
    try:
        dealt.select("_name", "value").write.partitionBy("_name").option("maxRecordsPerFile", 0).text(beside)
        vacant(spark, folder, mode)
        _by_name(spark, beside, folder, ending)
    finally:
        fs, at = _fs(spark, beside)
        fs.delete(at, True)


def _by_name(spark, beside: str, folder: str, ending: str) -> None:
    """folder/<name>.<ending> of the parts in each folder beside/_name=<name>."""
    fs, at = _fs(spark, beside)
    jvm_unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for found in fs.listStatus(at):
        label = found.getPath().getName()
        if label.startswith("_name="):
            join(spark, parts(spark, found.getPath().toString()), f"{folder.rstrip('/')}/{jvm_unescape(label.removeprefix('_name='))}.{ending}")


FOLDER_FILES = 1000  # that a folder of a file for each row has, about


def file_per_row(df: DataFrame, key: str, text: str, folder: str, ending: str = "html", mode: str = "overwrite") -> None:
    """folder/<number>/<key>.<ending> for each row: its text and a newline. A key's further rows are <key>~2, <key>~3.

    Names hang on the rows alone and a file is named once it is whole, so a task that runs again writes the same
    files. In a folder of the machines' own file system, shared by all, tasks write the files themselves: Hadoop's
    local store starts a process several times a file. Others are written by Spark, a folder a row, and renamed.
    """
    spark, beside = df.sparkSession, _beside(folder)
    name = F.coalesce(F.nullif(safe_name(F.col(key).cast("string")), F.lit("")), F.lit("null"))
    rows = df.select(name.alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_name").orderBy("value")))
    rows = rows.withColumn("_name", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("~"), F.col("_n").cast("string"))))
    fs, at = _fs(spark, beside)
    try:
        if fs.getUri().getScheme() == "file":
            folders, place = max(1, -(-df.count() // FOLDER_FILES)), at.toUri().getPath()
            fs.mkdirs(at)
            dealt = rows.select(F.concat_ws("/", F.lit(place), F.pmod(F.xxhash64("_name"), F.lit(folders)).cast("string"), F.concat("_name", F.lit(f".{ending}"))).alias("path"), "value")
            dealt.foreachPartition(_put_all)
            vacant(spark, folder, mode)
            if not fs.rename(at, _fs(spark, folder)[1]):
                raise OSError(f"can't name {folder}")
        else:
            rows.select("_name", "value").write.partitionBy("_name").text(beside)
            vacant(spark, folder, mode)
            _by_name(spark, beside, f"{folder.rstrip('/')}/0", ending)
    finally:
        fs.delete(at, True)


def _put_all(rows: Iterator) -> None:
    for r in rows:
        hidden = f"{os.path.dirname(r.path)}/.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(r.path), exist_ok=True)
        with open(hidden, "wb") as out:
            out.write(r.value.encode() + b"\n")
        os.replace(hidden, r.path)
