"""Row metrics of texts and predictions, and the choice of configurations by them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import count_full_lines, count_lines
from ..functions.text import ARABIC, WS, clean_text, col, has_script, not_blank, word_count

WEIGHTS = (0.5, 0.3, 0.2)  # of repetition, lost variety and word frequency in the composite


def counted_words(letters: str) -> Callable:
    """Of a text's words, once other characters than letters are gone: all, different ones, repeated ones, the most frequent one's.

    Such classes of characters, which Java tests range by range, took most of the time, so words are counted in Python.
    """
    # `str.split` parts at just the characters of WS
    other = re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", f"[^{letters}{WS[1:-1]}]+"))

    @F.pandas_udf("total_words long, unique_words long, repeated_words long, max_word_frequency long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        rows = [Counter(other.sub("", t).split()).values() for t in texts]
        return pd.DataFrame({"total_words": [sum(n) for n in rows], "unique_words": [len(n) for n in rows], "repeated_words": [sum(k > 1 for k in n) for n in rows], "max_word_frequency": [max(n, default=0) for n in rows]}, dtype="int64")

    return counts


def repetition(df: DataFrame, text: str, key: str, letters: str = ARABIC, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, total_words, unique_words, repeated_words, max_word_frequency) and the ratios made of them; zeros for texts without words.

    Words are counted within the row, so nothing is exchanged.
    """
    out = df.select(key, *keep, counted_words(letters)(F.coalesce(F.col(text), F.lit(""))).alias("_c")).select(key, *keep, "_c.*")
    n, t = F.col("total_words"), F.col("unique_words")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.withColumns({"word_repetition_rate": ratio(F.col("repeated_words") * 100.0, t), "unique_word_ratio": ratio(t, n), "avg_word_frequency": ratio(n, t)})


def composite(rate, unique, frequency, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Lower is better: repetition in percent, the share of words that are not unique, the mean frequency over one."""
    a, b, c = weights
    return a * col(rate) / 100 + b * (1 - col(unique)) + c * (col(frequency) - 1) / 10


def run_metrics(df: DataFrame, text: str, *by: str) -> DataFrame:
    """A run's lines: mean, population deviation, least and most."""
    return df.withColumn("_v", count_full_lines(text)).groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("avg_lines"), F.stddev_pop("_v").alias("std_lines"), F.min("_v").alias("min_lines"), F.max("_v").alias("max_lines"))


def generation_metrics(df: DataFrame, text: str, key: str, *by: str, letters: str = ARABIC) -> DataFrame:
    """A run's mean row metrics (`repetition`'s), and its lines' mean, population deviation, least and most."""
    rows = repetition(df.withColumn("_v", count_full_lines(text)), text, key, letters, keep=(*by, "_v"))
    means = ("word_repetition_rate", "unique_word_ratio", "avg_word_frequency", "max_word_frequency", "total_words", "unique_words")
    lines = [F.avg("_v").alias("avg_lines"), F.stddev_pop("_v").alias("std_lines"), F.min("_v").alias("min_lines"), F.max("_v").alias("max_lines")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(m).alias(f"mean_{m}") for m in means), *lines)


def best(df: DataFrame, group: str, name: str, score: str, lowest: bool = True) -> DataFrame:
    """(group, name, score) of the best by score, the first name among equals; null scores don't count."""
    rows = df.where(F.col(score).isNotNull())
    order = F.struct((F.col(score) if lowest else -F.col(score)).alias("s"), F.col(name).alias("n"))
    return rows.groupBy(group).agg(F.min_by(F.struct(name, score), order).alias("b")).select(group, f"b.{name}", f"b.{score}")


def prediction_metrics(df: DataFrame, predicted: str, reference: str, *by: str, exact: bool = True) -> DataFrame:
    """n, mean lengths, share of empty predictions, and share of exact matches where it makes sense."""
    p, r = clean_text(predicted), clean_text(reference)
    rows = df.select(*by, F.length(p).alias("p"), F.length(r).alias("r"), (p == "").cast("long").alias("e"), (p == r).cast("long").alias("m"))
    share = lambda c: F.sum(c) / F.count("*")
    aggs = [F.count("*").alias("n"), share("p").alias("avg_pred_len"), share("r").alias("avg_ref_len"), share("e").alias("empty_rate")]
    return rows.groupBy(*by).agg(*aggs, *([share("m").alias("exact_match")] if exact else []))


def success(df: DataFrame, kind: str, ok: Column) -> DataFrame:
    """(kind, n, succeeded, pct) per kind and overall ('ALL')."""
    both = F.explode(F.array(F.col(kind), F.lit("ALL")))
    return df.select(both.alias(kind), ok.cast("long").alias("_ok")).groupBy(kind).agg(F.count("*").alias("n"), F.sum("_ok").alias("succeeded"), (F.sum("_ok") * 100.0 / F.count("*")).alias("pct"))


def change_report(df: DataFrame, original: str, changed: str, kind: str, letters: str = ARABIC) -> DataFrame:
    """df with lengths, their change and what matters for the kind: lines kept (rhyme), valid JSON (era), words changed (meter)."""
    a, b, k = F.col(original), F.col(changed), F.col(kind)
    era = F.from_json(b, "corrupted_poem string, corrupted_era string")
    looks = b.rlike(r"(?s)^\s*\{.*\}\s*$")
    return df.withColumns(
        {
            "original_length": F.length(a),
            "changed_length": F.length(b),
            "length_change": F.length(b) - F.length(a),
            "has_script": has_script(b, letters),
            "line_count_preserved": F.when(k.startswith("rhyme"), count_lines(a) == count_lines(b)),
            "json_valid": F.when(k.startswith("era"), F.coalesce(looks, F.lit(False)) & era.isNotNull()),
            "has_changed_era": F.when(k.startswith("era"), F.coalesce(looks, F.lit(False)) & F.coalesce(era["corrupted_era"].isNotNull(), F.lit(False))),
            "word_count_change": F.when(k.startswith("meter"), word_count(b) - word_count(a)),
        }
    )


# Aspects a judge scores.
ASPECTS = ["constraint_satisfaction", "fluency", "coherence", "poeticness", "originality"]


def judged(df: DataFrame, reply: str, *by: str, aspects: list[str] = ASPECTS) -> DataFrame:
    """Means of the scores in a judge's JSON replies ({aspect: {score, reason}}); replies that are none don't count."""
    schema = ", ".join(f"{a} struct<score: double, reason: string>" for a in aspects)
    rows = df.withColumn("_j", F.from_json(reply, schema))
    return rows.groupBy(*by).agg(F.count(F.col(f"_j.{aspects[0]}.score")).alias("n"), *(F.avg(f"_j.{a}.score").alias(a) for a in aspects))


def empty_lines(c) -> Column:
    return ~F.coalesce(not_blank(c), F.lit(False))
