"""Operator 4: proportional stratified interleaving into shards of equal row counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, numbered

SEED = 42


def interleave(df: DataFrame, shards: int = 24, key: str = "doc_id", source: str = "source", keep: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """(key, *keep, shard, slot): every row in one shard, each shard with the whole's mixture of sources.

    Rows of a source are ranked by a seeded hash; (rank + 1/2) / rows of the source
    is a row's place between 0 and 1, and the rows of all sources sorted by place are
    cut into runs whose lengths differ by one at most. slot is gapless from 0 within
    a shard. Null sources form a stratum of their own; rows that are equal in every
    column that takes part (key, keep) are interchangeable, so their order does not
    show; with fewer rows than shards some shards are empty; an empty table gives no
    row; kept columns called shard or slot give way to the result's. Ranks come from range partitions and per-partition counts, so no source is
    gathered in one task. The result is a written table.
    """
    ws = Workspace(df.sparkSession, "sharding")
    keep = tuple(c for c in keep if c not in ("shard", "slot"))
    rows = df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    others = [F.col(f"_keep{i}") for i in range(len(keep))]
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_key").cast("string")))
    ranked = numbered(ws, rows, ["_source", "_hash", "_key", *(f"_keep{i}" for i in range(len(keep)))], "ranked").withColumnRenamed("pos", "_at")
    total = ranked.groupBy("_source").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumnRenamed("_source", "_of")
    placed = ranked.join(total, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_place", (F.col("_at") - F.col("_first") + 0.5) / F.col("_n"))
    placed = numbered(ws, placed.select("_key", "_source", "_hash", "_at", *others, "_place"), ["_place", "_source", "_at"], "placed")
    n = placed.count()
    # row p is in the shard s for which p is in [s n / shards, (s + 1) n / shards), in whole numbers
    shard = F.expr(f"((pos + 1) * {shards} - 1) div {max(n, 1)}")
    first = F.expr(f"(shard * {n}) div {shards}")
    placed = placed.withColumn("shard", shard.cast("int"))
    return ws.result(placed.select(F.col("_key").alias(key), *(o.alias(c) for o, c in zip(others, keep, strict=True)), "shard", (F.col("pos") - first).alias("slot")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = interleave(rows, 24, keep=("size", "text_crc32"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
