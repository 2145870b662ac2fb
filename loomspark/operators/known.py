"""An index of the texts that are known: signatures in buckets on disk, which new rows meet where they lie.

The index is a table of files in hash buckets of the content's signature. New rows are dealt out by the same
hash, so a join exchanges the new rows alone, and adding rows appends to the buckets. What a signature stands
for is its content, so an index can't be stale: a row that is known stays known, whatever loads came since.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Index:
    """Signatures (h, key) below a path, in so many buckets (at least as many as the session's shuffle partitions,
    or a join would deal both sides anew)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, kind: str = "long"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"known_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (h STRING, key {kind}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def signed(self, df: DataFrame, key: str, content: Column) -> DataFrame:
        """(h, key): rows' signatures; null contents have none."""
        return df.select(F.sha2(content, 256).alias("h"), F.col(key).alias("key")).where("h is not null")

    def unknown(self, df: DataFrame, key: str, content: Column) -> DataFrame:
        """(h, key) of contents that the index lacks, each with its smallest key."""
        new = self.signed(df, key, content).groupBy("h").agg(F.min("key").alias("key"))
        return new.join(self.rows().hint("merge"), "h", "left_anti")

    def add(self, df: DataFrame, key: str, content: Column) -> DataFrame:
        """Take in what the index lacks; returns these rows of df: the first of each new content."""
        from .scratch import written

        new = written(self.unknown(df, key, content), "unknown")
        # one file a bucket and load, not one of each task
        dealt = new.repartition(self.buckets, "h").select("h", "key")
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "h").sortBy("h").option("path", self.path).saveAsTable(self.name)
        return df.join(new.select(F.col("key").alias(key)), key, "left_semi")
