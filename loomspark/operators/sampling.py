"""Sampling and assignment. All randomness is the order of md5 over a seed and the row's key,
so it is the same on every run, in every partitioning and in other engines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

SEED = 42


def draw(key, seed: int | str = SEED, *more) -> Column:
    """The row's place in a seeded shuffle, as a hash to order by."""
    parts = [F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")]
    for m in more:
        parts += [F.lit(":"), m if isinstance(m, Column) else F.lit(str(m))]
    return F.md5(F.concat(*parts))


def uniform(key, seed: int | str = SEED, *more) -> Column:
    """A number in [0, 1) per row."""
    return F.conv(F.substring(draw(key, seed, *more), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick_index(n, key, seed: int | str = SEED, *more) -> Column:
    """A number from 0 to n - 1 per row."""
    return F.floor(uniform(key, seed, *more) * n).cast("int")


def sample(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """n rows without replacement; all if there are fewer. Top-n per partition first, so nothing is sorted as a whole."""
    return df.orderBy(draw(key, seed), key).limit(n)


def sample_per_group(df: DataFrame, n: int, group: str, key: str, seed: int = SEED) -> DataFrame:
    w = Window.partitionBy(group).orderBy(draw(key, seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def shuffle_keys(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """df with shuffle_key: sorting by it is a seeded shuffle, which no task has to hold as a whole."""
    return df.withColumn("shuffle_key", draw(key, seed))


def _numbered(rows: DataFrame, bucket, order: list) -> DataFrame:
    """rows with pos from 1: numbered within ordered buckets, whose first numbers are what the buckets before hold."""
    rows = rows.withColumn("_b", bucket)
    base = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    # as many rows as buckets, which is a constant
    base = base.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return ranked.join(F.broadcast(base), ranked["_b"].eqNullSafe(base["_b"])).withColumn("pos", F.col("_base") + F.col("_rn")).drop("_b", "_rn", "_base")


def positions(df: DataFrame, key: str, seed: int = SEED, digits: int = 3) -> DataFrame:
    """df with pos from 1 in seeded order; buckets are the first hex digits of the draw."""
    rows = df.withColumn("_h", draw(key, seed))
    return _numbered(rows, F.substring("_h", 1, digits), ["_h", key]).drop("_h")


def row_numbers(df: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """df with pos from 1 by a numeric column of distinct values.

    Buckets lie between quantiles, of which only their number reaches the driver; that
    these are approximate moves work between tasks, not rows between places.
    """
    cuts = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.5 / buckets)))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    return _numbered(df, bucket, [order])


def mixture(df: DataFrame, weights: dict[str, float], source: str, key: str, test_size: float = 0.0, seed: int = SEED) -> DataFrame:
    """int(rows * weight) rows of each named source, and split: the first part of each source's draw is test.

    Rows are numbered within a source's buckets (the draw's first three digits), whose first
    numbers come from counts, so no task holds a source.
    """
    weight = F.coalesce(*(F.when(F.col(source) == s, F.lit(float(w))) for s, w in weights.items()))
    rows = df.withColumns({"_w": weight, "_h": draw(key, seed)}).where("_w is not null").withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(source, "_b").agg(F.count("*").alias("_c"), F.first("_w").alias("_w"))
    own = Window.partitionBy(source)
    # 4096 rows a named source at most
    counts = counts.select(F.col(source).alias("_of"), F.col("_b").alias("_in"), F.floor(F.sum("_c").over(own) * F.col("_w")).alias("_n"), F.coalesce(F.sum("_c").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(source, "_b").orderBy("_h", key)))
    ranked = ranked.join(F.broadcast(counts), (F.col(source) == F.col("_of")) & (F.col("_b") == F.col("_in"))).withColumn("_rn", F.col("_rn") + F.col("_base")).where("_rn <= _n")
    return ranked.withColumn("split", F.when(F.col("_rn") <= F.ceil(F.col("_n") * test_size), "test").otherwise("train")).drop("_w", "_h", "_b", "_of", "_in", "_n", "_base", "_rn")


FRACTIONS = (0.10, 0.25, 0.50, 1.0)  # shares of the eligible rows that the passes over the templates take


def claim(df: DataFrame, eligible: list[Column], key: str, fractions: tuple[float, ...] = FRACTIONS, seed: int = SEED) -> DataFrame:
    """df with template: the number of the template that claims the row, null if none can.

    Passes go over all templates in order, each taking its fraction of the rows that are
    eligible and unclaimed. A row walks the steps on its own: at each it is taken with the
    step's fraction as probability, so the shares are the passes' in expectation and
    no step waits for another. The last fraction, 1, leaves no eligible row.
    """
    # a condition may be dear, so each is a column of its own, which the branches name
    flags = {f"_e{t}": F.coalesce(ok, F.lit(False)) for t, ok in enumerate(eligible)}
    out = F.lit(None).cast("int")
    steps = [(share, t) for share in fractions for t in range(len(eligible))]
    for step, (share, t) in reversed(list(enumerate(steps))):
        out = F.when(F.col(f"_e{t}") & (uniform(key, seed, step) < share), F.lit(t)).otherwise(out)
    return df.withColumns(flags).withColumn("template", out).drop(*flags)


PATTERNS = 4096  # eligibility patterns up to which steps are solved on their counts


def patterns(df: DataFrame, eligible: list[Column], key: str) -> tuple[DataFrame, list[int]]:
    """(key, pattern): which of the conditions hold, a hex digit for every four; and each template's place in it.

    Equal conditions, of which many templates have the same, are one.
    """
    own = {str(e): e for e in eligible}
    place = {name: k for k, name in enumerate(own)}
    bits = [F.coalesce(e, F.lit(False)).cast("int") for e in own.values()]
    digits = [F.hex(sum((b * (1 << j) for j, b in enumerate(bits[k : k + 4])), F.lit(0)).cast("long")) for k in range(0, len(bits), 4)]
    return df.select(key, F.concat(*digits).alias("pattern")), [place[str(e)] for e in eligible]


def solved(counts: dict[str, int], places: list[int], steps: list) -> list[tuple[str, int, int, int]]:
    """(pattern, first, last, template): which of each pattern's rows, from 0, every step takes.

    steps: (template, function of the eligible rows that are left to how many are taken). A step
    takes from each pattern in proportion to what is left of it; what rounding leaves goes to the
    largest remainders, of equal ones to the first patterns.
    """
    names = sorted(counts)
    left, used = [counts[x] for x in names], [0] * len(names)
    fits = [[i for i, x in enumerate(names) if int(x[p // 4], 16) >> p % 4 & 1] for p in places]
    out = []
    for t, amount in steps:
        own = [i for i in fits[t] if left[i]]
        total = sum(left[i] for i in own)
        n = min(amount(total), total)
        if n <= 0:
            continue
        take = {i: n * left[i] // total for i in own}
        rest = sorted(own, key=lambda i: (-(n * left[i] % total), names[i]))
        for i in rest[: n - sum(take.values())]:
            take[i] += 1
        for i, m in take.items():
            if m:
                out.append((names[i], used[i], used[i] + m - 1, t))
                used[i] += m
                left[i] -= m
    return out


def by_patterns(df: DataFrame, eligible: list[Column], key: str, steps: list, seed: int = SEED) -> DataFrame | None:
    """(key, template) of the rows that the steps take; None if there are more than PATTERNS patterns.

    Two scans of the keys' patterns, which are written once: their counts, by pattern and
    bucket of the draw (4096 a pattern at most), reach the driver; then rows are numbered within
    buckets, in seeded order, and look up the step that takes their number. However many steps
    there are, rows are exchanged once, and a pattern that most rows have is dealt by its buckets.
    """
    rows, places = patterns(df, eligible, key)
    rows = written(rows.withColumn("_h", draw(key, seed)).withColumn("_b", F.substring("_h", 1, 3)), "patterns")
    if rows.select("pattern").distinct().limit(PATTERNS + 1).count() > PATTERNS:
        return None
    counts = rows.groupBy("pattern", "_b").agg(F.count("*").alias("c"))
    totals = {r[0]: r[1] for r in counts.groupBy("pattern").agg(F.sum("c")).collect()}
    base = counts.select("pattern", "_b", F.coalesce(F.sum("c").over(Window.partitionBy("pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    taken: dict[str, list] = {}
    for pattern, first, last, t in solved(totals, places, steps):
        taken.setdefault(pattern, []).append((last, t, first))
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("pattern", "_b").orderBy("_h", key)) - 1).join(base, ["pattern", "_b"])

    @F.pandas_udf("int")
    def template(pattern: pd.Series, n: pd.Series) -> pd.Series:
        out = pd.Series(-1, index=pattern.index, dtype="int32")
        for name, own in n.groupby(pattern).groups.items():
            ends = taken.get(name, [])
            if ends:
                at = np.searchsorted([e[0] for e in ends], n[own])
                out[own] = np.array([*(e[1] for e in ends), -1], np.int32)[at]
        return out

    return numbered.select(key, template("pattern", F.col("_base") + F.col("_rn")).alias("template")).where("template >= 0")


def claim_exact(df: DataFrame, eligible: list[Column], key: str, fractions: tuple[float, ...] = FRACTIONS, seed: int = SEED) -> DataFrame:
    """(key, template) of the claimed rows, step by step: each takes int(fraction * rows) of the rows that are
    eligible and unclaimed when its turn comes, spread evenly over the rows' eligibility patterns.

    Steps are solved on the patterns' counts (see `by_patterns`), so thousands of templates
    cost no more jobs than three. With more than PATTERNS patterns the steps are taken one
    after the other (see `claim_steps`): as many rows each, in the order of another draw.
    """
    amount = lambda share: lambda total: int(share * total)
    steps = [(t, amount(share)) for share in fractions for t in range(len(eligible))]
    out = by_patterns(df, eligible, key, steps, seed)
    return claim_steps(df, eligible, key, fractions, seed) if out is None else out


def claim_steps(df: DataFrame, eligible: list[Column], key: str, fractions: tuple[float, ...] = FRACTIONS, seed: int = SEED) -> DataFrame:
    """As `claim_exact`, a written table a step, each in a seeded order of its own; for any number of patterns."""
    flags = written(df.select(key, *(F.coalesce(e, F.lit(False)).alias(f"_e{k}") for k, e in enumerate(eligible))), "eligible")
    out, step = None, 0
    for f in fractions:
        for t in range(len(eligible)):
            free = flags.where(f"_e{t}").select(key)
            if out is not None:
                free = free.join(out.select(key), key, "left_anti")
            free = written(positions(free, key, f"{seed}:{step}"), "free")
            own = free.where(F.col("pos") <= int(f * free.count())).select(key, F.lit(t).alias("template"))
            out = own if out is None else out.unionByName(own)
            step += 1
    return out


def capped(df: DataFrame, most: int, key: str, seed: int = SEED) -> DataFrame:
    """At most so many claimed rows, the earlier templates' first."""
    return df.where("template is not null").orderBy("template", draw(key, seed), key).limit(most)


def quotas(df: DataFrame, eligible: list[Column], total: int, key: str, taken: list[int] | None = None, seed: int = SEED) -> DataFrame:
    """(key, template): each template gets total // templates rows less what it has, the last template first.

    A template takes from its eligible rows that no later template took, spread evenly over
    their eligibility patterns and in seeded order within each; see `by_patterns`. With more than
    PATTERNS patterns the templates take their rows one after the other.
    """
    base, n = total // len(eligible), len(eligible)
    quota = [max(0, base - (taken[t] if taken else 0)) for t in range(n)]
    amount = lambda t: lambda _: quota[t]
    out = by_patterns(df, eligible, key, [(t, amount(t)) for t in reversed(range(n))], seed)
    if out is not None:
        return out
    flags = df.select(key, *(F.coalesce(e, F.lit(False)).alias(f"_e{k}") for k, e in enumerate(eligible)))
    for t in reversed(range(n)):
        free = flags.where(f"_e{t}").select(key)
        if out is not None:
            free = free.join(out.select(key), key, "left_anti")
        own = free.orderBy(draw(key, seed, t), key).limit(quota[t]).withColumn("template", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out


def remaining(assigned: DataFrame, template: str, total: int, templates: int) -> DataFrame:
    """(template, left): what the quota of each template, numbered from 0, still allows."""
    all_ = assigned.sparkSession.range(templates).select(F.col("id").cast("int").alias(template))
    used = assigned.where(F.col(template).isNotNull()).groupBy(template).count()
    return all_.join(used, template, "left").select(template, F.greatest(F.lit(0), F.lit(total // templates) - F.coalesce("count", F.lit(0))).cast("long").alias("left"))


def variant(variants, key, seed: int = SEED) -> Column:
    """One of an array's items per row."""
    variants = F.col(variants) if isinstance(variants, str) else variants
    return F.get(variants, pick_index(F.size(variants), key, seed))


def other_than(choices: list[str], current, key, seed: int = SEED, default=None) -> Column:
    """A choice that differs from the current value; the default, else the current value, if there is none."""
    current = F.col(current) if isinstance(current, str) else current
    rest = F.filter(F.array(*map(F.lit, choices)), lambda x: ~x.eqNullSafe(current))
    return F.coalesce(variant(rest, key, seed), F.lit(default) if default is not None else current)


# Answer letters, of the newer and the older question builder.
LETTERS = ["أ", "ب", "ج", "د", "هـ"]
OLD_LETTERS = ["أ", "ب", "ج", "د", "و"]


def choices(df: DataFrame, answer: str, key: str, distractors: int = 4, strict: bool = False, letters: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """df with choices (letter to value), correct_choice: the answer among other values of its column, shuffled.

    Other values are taken from a run of neighbours in the seeded order of all distinct
    values, which begins at the row's draw; the answer itself is left out of it. Values
    are numbered by buckets and looked up in an equi join, so there may be any number of
    them. strict: rows with too few other values are left out; otherwise they get what
    there is. Rows without an answer are left out.
    """
    letters = letters or (OLD_LETTERS if strict else LETTERS)
    value = F.trim(F.col(answer).cast("string"))
    rows = df.where(value.isNotNull() & (value != ""))
    pool = positions(rows.select(value.alias("_v")).distinct(), "_v", seed)
    n = pool.count()
    near = F.explode(F.transform(F.sequence(F.lit(0), F.lit(distractors)), lambda j: F.struct(j.alias("j"), F.pmod(F.col("pos") - 1 - j, F.lit(max(n, 1))).alias("_start"))))
    runs = pool.select("_v", near.alias("x")).groupBy(F.col("x._start").alias("_start")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("x.j", "_v"))), lambda x: x["_v"])).alias("_run"))
    rows = rows.withColumn("_start", pick_index(n, key, seed).cast("long")).join(runs, "_start")
    order = lambda arr, s: F.transform(F.array_sort(F.transform(arr, lambda v: F.struct(draw(key, s, v).alias("h"), v.alias("v")))), lambda x: x["v"])
    rows = rows.withColumn("_o", F.slice(F.filter("_run", lambda v: v != value), 1, distractors))
    if strict:
        rows = rows.where(F.size("_o") >= distractors)
    shuffled = order(F.concat(F.col("_o"), F.array(value)), seed + 1)
    rows = rows.withColumn("_c", shuffled)
    names = F.array(*map(F.lit, letters))
    return rows.withColumn("choices", F.map_from_arrays(F.slice(names, F.lit(1), F.size("_c")), F.col("_c"))).withColumn("correct_choice", F.get(names, (F.array_position("_c", value) - 1).cast("int"))).drop("_start", "_run", "_o", "_c")
