"""Intermediate tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where none is named and one machine runs all (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.conf.get("loomspark.shared.dir", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="loomspark-")
            spark.conf.set("loomspark.shared.dir", at)
    return at.rstrip("/")


_ROOTS: list[str] = []  # of the workspaces that are open


def root(spark: SparkSession) -> str:
    """Where tables go now: the innermost workspace, else the shared folder."""
    return _ROOTS[-1] if _ROOTS else shared_dir(spark)


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """What is written inside is deleted at the end, so results have to be used, or written elsewhere, before."""
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    _ROOTS.append(path)
    try:
        yield path
    finally:
        _ROOTS.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and reread, with the schema it had: what reads it several times computes it once."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
