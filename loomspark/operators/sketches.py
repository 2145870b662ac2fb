"""Statistics that merge: states of distinct counts and quantiles, stored by source and load, united on read.

A load scans its own rows and leaves one state for each group; totals over all loads, or over some, come from
the states alone. Distinct counts are HyperLogLog states: with 2^bits registers the standard error is
1.04 / sqrt(2^bits), 0.8 % at 14. Quantiles are KLL states with k 200: a rank is off by 1.7 % at most, with
99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 14
POINTS = (0.25, 0.5, 0.75, 0.95)


def states(df: DataFrame, by: list[str], distinct: dict[str, object], spread: dict[str, object], bits: int = BITS) -> DataFrame:
    """(by, rows, d_<name> of each distinct value's state, q_<name> of each whole number's): one row a group, combined before the shuffle."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        *(F.hll_sketch_agg(c, F.lit(bits)).alias(f"d_{n}") for n, c in distinct.items()),
        *(F.kll_sketch_agg_bigint(c).alias(f"q_{n}") for n, c in spread.items()),
    )


def store(states_: DataFrame, path: str, load: str) -> None:
    """Keep a load's states; a load that is stored again replaces its own."""
    states_.write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load}")


def united(spark: SparkSession, path: str, by: list[str], loads: list[str] | None = None, points: tuple[float, ...] = POINTS) -> DataFrame:
    """(by, rows, distinct_<name>, quantiles_<name>): estimates over all loads, or the named ones."""
    held = spark.read.parquet(path)
    if loads is not None:
        held = held.where(F.col("load").cast("string").isin(loads))
    d, q = ([c[2:] for c in held.columns if c.startswith(mark)] for mark in ("d_", "q_"))
    out = held.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.hll_union_agg(f"d_{n}").alias(f"d_{n}") for n in d), *(F.kll_merge_agg_bigint(f"q_{n}").alias(f"q_{n}") for n in q))
    at = F.array(*map(F.lit, points))
    return out.select(*by, "rows", *(F.hll_sketch_estimate(f"d_{n}").alias(f"distinct_{n}") for n in d), *(F.kll_sketch_get_quantile_bigint(f"q_{n}", at).alias(f"quantiles_{n}") for n in q))
