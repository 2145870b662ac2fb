"""Enrichment by outside models: pluggable providers, resumable runs, results joined back."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import row_number_id
from .sampling import row_numbers


def with_retries(call: Callable, attempts: int = 3, delay: float = 1.0, growth: float = 2.0) -> Callable:
    """call, tried again after a growing delay; the last error is raised."""

    def run(batch):
        for k in range(attempts):
            try:
                return call(batch)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(delay * growth**k)

    return run


def complete(df: DataFrame, prompt: str, provider: Callable[[list[str]], list[str]], out: str = "model_generation", parallel: int | None = None, most: int = 1000) -> DataFrame:
    """df with out: the provider's reply to each prompt; null prompts have none.

    provider is called with at most so many prompts at a time; parallel bounds how many calls are under way.
    """
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n != out), f"`{out}` string"])
    names = [c for c in df.columns if c != out]

    def run(parts):
        for part in parts:
            ask = part[prompt].notna()
            replies = pd.Series([None] * len(part), index=part.index, dtype=object)
            if ask.any():
                own = part.loc[ask, prompt].tolist()
                replies[ask] = [r for k in range(0, len(own), most) for r in provider(own[k : k + most])]
            yield part[names].assign(**{out: replies})

    rows = df.select(*names)
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, schema)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no result yet."""
    return todo.join(done.select(key), key, "left_anti")


def resume(todo: DataFrame, path: str, key: str, step: Callable[[DataFrame], DataFrame], saves: int = 1) -> DataFrame:
    """Append step's results for the rows that the table at path lacks; returns the whole table.

    A run that is lost leaves whole files only, and the next one does what is missing.
    saves: the rows are dealt by a hash of their keys into so many parts, each saved when it is done.
    """
    spark = todo.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    have = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    rest = pending(todo, spark.read.parquet(path), key) if have else todo
    for k in range(saves):
        step(rest.where(F.pmod(F.xxhash64(key), F.lit(saves)) == k) if saves > 1 else rest).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def merge_back(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns' new values where there are any."""
    fresh = new.select(key, *(F.col(c).alias(f"{c}_new") for c in columns))
    joined = base.join(fresh, key, "left")
    return joined.withColumns({c: F.coalesce(f"{c}_new", c) if c in base.columns else F.col(f"{c}_new") for c in columns}).drop(*(f"{c}_new" for c in columns))


def rows_by_id(output: DataFrame, base: DataFrame, output_id: str, order: str) -> DataFrame:
    """output joined to the base row that its id p<n>_r<row> numbers, from 0 in the order; other ids are dropped."""
    numbered = row_numbers(base, order).withColumn("_row", F.col("pos") - 1).drop("pos")
    parsed = output.withColumn("_p", row_number_id(output_id)).where("_p is not null")
    return parsed.withColumn("prompt_num", F.col("_p.prompt")).withColumn("_row", F.col("_p.row")).drop("_p").join(numbered, "_row").drop("_row")


def zipped(a: DataFrame, b: DataFrame, a_order: str, b_order: str, key: str) -> DataFrame:
    """Rows of two equally long tables side by side, by their places in the numeric orders; side: a coin per row."""
    both = row_numbers(a, a_order).join(row_numbers(b, b_order), "pos").drop("pos")
    return both.withColumn("side", F.when(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 1), 16, 10).cast("int") % 2 == 0, "a").otherwise("b"))


def matched_names(a: DataFrame, b: DataFrame, name: str, prefixes: str = "ar_|en_") -> DataFrame:
    """Names that both tables have once a language prefix is taken off."""
    bare = lambda df, side: df.select(F.regexp_replace(name, f"^(?:{prefixes})", "").alias("stem"), F.col(name).alias(side))
    return bare(a, "left_name").join(bare(b, "right_name"), "stem")
