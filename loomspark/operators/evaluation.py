"""Human evaluation: scores, agreement, tests of difference, blind sheets; accuracy tables."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import SEED, draw

# Criteria of the score sheets.
CRITERIA = ["الالتزام_بالقيود", "الطلاقة_اللغوية_والإيقاع", "التماسك_والمعنى", "الشاعرية_والجمال_الفني"]


def row_mean(columns: list[str]) -> Column:
    """The mean of a row's scores that are there."""
    own = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scores as numbers; what is none becomes null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def model_scores(df: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """Mean, sample deviation and count of every criterion and of the row mean, per model."""
    rows = df.withColumn("overall", row_mean(columns))
    aggs = [f(c).alias(f"{c}_{n}") for c in [*columns, "overall"] for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))]
    return rows.groupBy(model).agg(*aggs)


def ranked(df: DataFrame, model: str, score: str) -> DataFrame:
    """df with rank by score, the best first; as many rows as models."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), model)))


def best_per_criterion(df: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """(criterion, model, score) of the model with the best mean."""
    means = df.groupBy(model).agg(*(F.avg(c).alias(c) for c in columns))
    long = means.select(model, F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in columns))).alias("x")).select(model, "x.*").where("score is not null")
    top = F.min_by(F.struct(model, "score"), F.struct((-F.col("score")).alias("s"), F.col(model).alias("m")))
    return long.groupBy("criterion").agg(top.alias("b")).select("criterion", f"b.{model}", "b.score")


def coverage(df: DataFrame, item: list[str], annotator: str) -> DataFrame:
    """(one, two, three_or_more): how many items have so many annotators."""
    n = df.groupBy(*item).agg(F.count_distinct(annotator).alias("n"))
    return n.agg(*(F.count(F.when(c, 1)).alias(name) for name, c in (("one", F.col("n") == 1), ("two", F.col("n") == 2), ("three_or_more", F.col("n") >= 3))))


def agreement(df: DataFrame, item: list[str], annotator: str, columns: list[str]) -> DataFrame:
    """(criterion, correlation, pairs): Pearson correlation of each two annotators over common items, averaged; undefined ones don't count."""
    a = df.select(*item, F.col(annotator).alias("a"), *(F.col(c).alias(f"x{k}") for k, c in enumerate(columns)))
    b = df.select(*item, F.col(annotator).alias("b"), *(F.col(c).alias(f"y{k}") for k, c in enumerate(columns)))
    pairs = a.join(b, item).where("a < b").groupBy("a", "b").agg(*(F.corr(f"x{k}", f"y{k}").alias(f"r{k}") for k in range(len(columns))))
    long = pairs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.when(~F.isnan(f"r{k}"), F.col(f"r{k}")).alias("r")) for k, c in enumerate(columns)))).alias("x")).select("x.*")
    return long.groupBy("criterion").agg(F.avg("r").alias("correlation"), F.count("r").alias("pairs"))


def variance_ratio(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, f): one-way analysis of variance by the groups' n, sum and sum of squares."""
    sums = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    one = sums.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    f = F.when((F.col("groups") > 1) & (F.col("n") > F.col("groups")) & (within > 0), (between / (F.col("groups") - 1)) / (within / (F.col("n") - F.col("groups"))))
    return one.select("groups", "n", f.alias("f"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        t = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + t * d) or 1e-300)
        c = (1 + t / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_p_value(f: float, between: int, within: int) -> float:
    """P(F >= f)."""
    return _beta_tail(within / 2, between / 2, within / (within + between * f))


@F.pandas_udf(T.DoubleType())
def _tails(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else f_p_value(x, a, b) for x, a, b in zip(f, between, within, strict=True)], dtype=float)


def tests(df: DataFrame, group: str, columns: list[str], level: float = 0.05) -> DataFrame:
    """(criterion, groups, n, f, p, significant): the test of every criterion; F is t squared where there are two groups."""
    rows = reduce(DataFrame.unionByName, [variance_ratio(df, group, c).withColumn("criterion", F.lit(c)) for c in columns])
    rows = rows.withColumn("p", _tails("f", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")))
    return rows.select("criterion", "groups", "n", "f", "p", F.coalesce(F.col("p") < level, F.lit(False)).alias("significant"))


def significance(df: DataFrame, group: str, value: str, level: float = 0.05) -> dict:
    """The test over all groups: {groups, n, f, p, significant}; for two groups F is the square of Student's t."""
    row = variance_ratio(df, group, value).first()
    p = f_p_value(row["f"], row["groups"] - 1, row["n"] - row["groups"]) if row["f"] is not None else None
    return {"groups": row["groups"], "n": row["n"], "f": row["f"], "p": p, "significant": p is not None and p < level}


def blind_names(models: list[str], spark, seed: int = SEED) -> DataFrame:
    """(model, model_id): names model_1, model_2 ... in seeded order; as many rows as models."""
    rows = spark.createDataFrame([(m,) for m in models], "model string")
    return rows.withColumn("model_id", F.concat(F.lit("model_"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(draw("model", seed))).cast("string")))


def blind_sheet(df: DataFrame, item: str, model: str, models: list[str], n: int, key: str, seed: int = SEED) -> DataFrame:
    """(sample_id, model_id, sheet_key, *df): n items that all models have, each model's first row, under blind names.

    sample_id numbers the n items; sorting by sheet_key shuffles the sheet.
    """
    rows = df.where(F.col(model).isin(*models))
    common = rows.groupBy(item).agg(F.count_distinct(model).alias("c")).where(F.col("c") == len(models)).select(item)
    chosen = common.orderBy(draw(item, seed), item).limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(draw(item, seed), item)
    chosen = chosen.withColumn("sample_id", F.format_string("sample_%03d", F.row_number().over(w)))
    first = rows.join(F.broadcast(chosen), item).withColumn("_rn", F.row_number().over(Window.partitionBy(item, model).orderBy(key))).where("_rn = 1").drop("_rn")
    named = first.join(F.broadcast(blind_names(models, df.sparkSession, seed)), first[model] == F.col("model")) if model != "model" else first.join(F.broadcast(blind_names(models, df.sparkSession, seed)), "model")
    return named.withColumn("sheet_key", draw(F.concat("sample_id", F.lit("/"), "model_id"), seed))


def accuracy_matrix(df: DataFrame, model: str, task: str, value: str, tasks: list[str]) -> DataFrame:
    """A row per model, a column per task, Overall (the mean over tasks) first; '' where there is none."""
    wide = df.groupBy(model).pivot(task, tasks).agg(F.first(value))
    overall = row_mean(tasks)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return wide.select(model, shown(overall).alias("Overall"), *(shown(F.col(f"`{t}`")).alias(t) for t in tasks))


def harness_results(df: DataFrame, body: str) -> DataFrame:
    """df with task and accuracy, a row per task of a results JSON."""
    found = F.from_json(body, "results map<string, map<string, double>>")["results"]
    return df.select("*", F.explode(found).alias("task", "_m")).withColumn("accuracy", F.try_element_at("_m", F.lit("acc,none"))).drop("_m")


def merged(sheets: dict[str, DataFrame]) -> DataFrame:
    """All annotators' sheets under one another, with annotator."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("annotator", F.lit(n)) for n, df in sheets.items()])
