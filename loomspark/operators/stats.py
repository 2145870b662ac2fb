"""Corpus statistics. Every report is an aggregate that combines before its shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import count_lines
from ..functions.missing import is_missing, same
from ..functions.text import not_blank, word_count


def origins(df: DataFrame, origin: Column, text: str, digits: int | None = None) -> DataFrame:
    """(origin, samples, non_empty, avg_chars, avg_lines) per origin, the largest first, then TOTAL.

    TOTAL's averages are the groups' averages, weighted: characters by non-empty samples, lines by all.
    digits: averages are rounded, and TOTAL's come from the groups' rounded ones, as in a printed table.
    """
    full = not_blank(text)
    rows = df.select(origin.alias("origin"), F.when(full, F.length(text)).alias("c"), F.when(F.col(text).isNotNull(), count_lines(text)).alias("l"))
    own = rows.groupBy("origin").agg(F.count("*").alias("samples"), F.count("c").alias("non_empty"), F.sum("c").alias("c"), F.sum("l").alias("l"), F.count("l").alias("nl"))
    if digits is not None:
        own = own.withColumns({"c": F.round(F.col("c") / F.col("non_empty"), digits) * F.col("non_empty"), "l": F.round(F.col("l") / F.col("nl"), digits) * F.col("nl")})
    total = own.agg(F.sum("samples").alias("samples"), F.sum("non_empty").alias("non_empty"), F.sum("c").alias("c"), F.sum(F.col("l") * F.col("samples") / F.col("nl")).alias("l"), F.sum("samples").alias("nl"))
    both = own.withColumn("l", F.col("l").cast("double")).withColumn("is_total", F.lit(0)).unionByName(total.withColumn("origin", F.lit("TOTAL")).withColumn("is_total", F.lit(1)))
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    out = both.select("origin", "samples", "non_empty", shown(F.col("c") / F.col("non_empty")).alias("avg_chars"), shown(F.col("l") / F.col("nl")).alias("avg_lines"), "is_total")
    return out.orderBy("is_total", F.desc("samples"), "origin").drop("is_total")


def nested_origin(name: str, parent: str, child: str, prefix: str | None = None) -> Column:
    """A data set's name; for one of them, its name and the sub-source."""
    return F.when(F.col(name) == parent, F.concat(F.lit(f"{prefix or parent}_"), F.col(child))).otherwise(F.col(name))


def missing_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n_missing, n_rows), a row per column."""
    names = columns or tuple(df.columns)
    one = df.agg(F.count("*").alias("n_rows"), *(F.count(F.when(is_missing(c), 1)).alias(f"m{k}") for k, c in enumerate(names)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{k}").alias("n_missing"), F.col("n_rows")) for k, c in enumerate(names)))).alias("x")).select("x.*")


def completion(df: DataFrame, *columns: str) -> DataFrame:
    """(column, pct) of rows that have a value."""
    one = df.agg(*((F.count(c) * 100.0 / F.count("*")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("pct")) for c in columns))).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    rows = df if with_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts, 0 where there are none; the columns' values are given, so that no pass has to find them."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


EMPTY = "d41d8cd98f00b204e9800998ecf8427e"  # fixed value: md5 of the empty text


def by_text(df: DataFrame, text: Column) -> DataFrame:
    """(h, n): rows of each distinct text, which is told by its md5 and never shuffled; null for null texts.

    A condition on h that came before the grouping would evaluate the text expression
    again, so `full` (neither null nor empty) is told afterwards.
    """
    return df.select(F.md5(text).alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.max("h").alias("m")).select("h", "n", (F.col("m").isNotNull() & (F.col("m") != EMPTY)).alias("full"), "m")


def duplicates(df: DataFrame, text: Column) -> DataFrame:
    """(total, non_empty, distinct_texts, duplicate_rows, duplicate_values) of a text expression."""
    full = lambda x, more=F.lit(True): F.when(F.col("full") & more, x)
    return by_text(df, text).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(full(F.col("n"))), F.lit(0)).alias("non_empty"),
        F.count(full(F.lit(1))).alias("distinct_texts"),
        F.coalesce(F.sum(full(F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count(full(F.lit(1), F.col("n") > 1)).alias("duplicate_values"),
    )


def top_duplicates(df: DataFrame, text: Column, k: int = 10) -> DataFrame:
    """(t, n): the k commonest texts. Texts are counted by hash; only those of the winners, and of
    what ties with the last of them, are looked up, as the order among equals is the texts'."""
    counts = by_text(df, text).where("full and n > 1").select("h", "n")
    last = counts.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("least"))
    some = counts.join(F.broadcast(last), F.col("n") >= F.col("least")).select("h", "n")  # one row
    rows = df.select(text.alias("t")).withColumn("h", F.md5("t"))
    return rows.join(some, "h").groupBy("h").agg(F.first("t").alias("t"), F.first("n").alias("n")).orderBy(F.desc("n"), "t").limit(k).select("t", "n")


def overlap(a: DataFrame, b: DataFrame, text: Column) -> DataFrame:
    """(shared, in_either, pct) of the distinct texts of two tables."""
    mark = lambda df, n: by_text(df, text).where("m is not null").select("h", F.lit(1).alias(n))
    both = mark(a, "a").join(mark(b, "b"), "h", "full_outer")
    out = both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"), F.count("*").alias("in_either"))
    return out.withColumn("pct", F.when(F.col("in_either") > 0, F.col("shared") * 100.0 / F.col("in_either")).otherwise(0.0))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from low to high; 0 below and bins + 1 from high on."""
    return df.select(F.width_bucket(value.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def density(df: DataFrame, value: Column, points: list[float]) -> DataFrame:
    """(x, density): a Gaussian kernel estimate at each point, its bandwidth n^(-1/5) sample deviations.

    Equal values are counted first, so what meets the points is distinct values.
    """
    own = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").cast("double").alias("n"))
    one = own.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q"))
    one = one.select("t", (F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("t")) / (F.col("t") - 1)) * F.pow("t", F.lit(-0.2))).alias("h"))
    rows = own.join(F.broadcast(one)).where("h > 0")  # one row
    at = F.explode(F.array(*(F.lit(float(p)) for p in points))).alias("x")
    bump = F.col("n") * F.exp(-F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2.0)) / 2)
    return rows.select("v", "n", "t", "h", at).groupBy("x").agg((F.sum(bump) / (F.first("t") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))


def spread(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """min, max, total and mean."""
    return df.withColumn("_v", value).groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.sum("_v").alias("total"), (F.sum("_v") / F.count("_v")).alias("mean"))


def word_totals(df: DataFrame, text: str, *by: str) -> DataFrame:
    n = F.coalesce(word_count(F.coalesce(F.col(text), F.lit(""))), F.lit(0)).cast("long")
    return df.withColumn("_w", n).groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("_w").alias("n_words"), (F.sum("_w") / F.count("*")).alias("words_per_row"))


def column_equality(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, matches, differences, pct): values of rows with one key, trimmed, null equal to null."""
    left, right = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns)), b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns))
    one = left.join(right, key).agg(F.count("*").alias("n"), *(F.count(F.when(same(f"a_{c}", f"b_{c}"), 1)).alias(f"m_{c}") for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("matches"), (F.col("n") - F.col(f"m_{c}")).alias("differences"), (F.col(f"m_{c}") * 100.0 / F.col("n")).alias("pct")) for c in columns))).alias("x")).select("x.*")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The rows with one of the k commonest values; ties go to the smaller value."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k).select(column)
    return df.join(F.broadcast(top), column, "left_semi")  # k rows


def in_all(df: DataFrame, value: str, group: str, groups: int) -> DataFrame:
    """Values that occur in every group."""
    return df.groupBy(value).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") == groups).select(value)
