"""Texts as lines: verses, hemistichs, endings, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, not_blank, trim_ws

#: A number that stands between verses; digits of all scripts.
NUMBER_MARK = r"(?U)\n*\b\d+\b\n*"


def lines(c) -> Column:
    return F.split(col(c), "\n")


def full_lines(c) -> Column:
    """Lines that are not blank, as they are."""
    return F.filter(lines(c), not_blank)


def count_lines(c) -> Column:
    """Newlines and one; blank lines count."""
    return F.size(lines(c))


def count_full_lines(c) -> Column:
    """Lines that are not blank; 0 for null."""
    return F.coalesce(F.when(col(c).isNotNull(), F.size(full_lines(c))), F.lit(0))


def count_newlines(c) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit("\n"), F.lit("")))


def _halves(own: Column) -> Column:
    """(left, right) of the lines two by two; an odd last line has a null right. No line is looked up by number."""
    left, right = F.filter(own, lambda _, k: k % 2 == 0), F.filter(own, lambda _, k: k % 2 == 1)
    return F.arrays_zip(left.alias("left"), right.alias("right"))


def pair_lines(c, odd: str = "drop") -> Column:
    """Lines two by two with a tab between, one pair a line.

    odd: what happens to an odd last line: 'drop' it, 'leave' the whole text as it is, or
    'pad' it with an empty half.
    """
    own = lines(c)
    pairs = _halves(own)
    if odd != "pad":
        pairs = F.slice(pairs, F.lit(1), F.floor(F.size(own) / 2).cast("int"))
    out = F.array_join(F.transform(pairs, lambda p: F.concat(p["left"], F.lit("\t"), F.coalesce(p["right"], F.lit("")))), "\n")
    return F.when(F.size(own) % 2 == 0, out).otherwise(col(c)) if odd == "leave" else out


def line_pairs(c) -> Column:
    """Consecutive lines as (sadr, ajz); an odd last line is left out."""
    full = F.filter(_halves(lines(c)), lambda p: p["right"].isNotNull())
    return F.transform(full, lambda p: F.struct(p["left"].alias("sadr"), p["right"].alias("ajz")))


def ending(c, share: float = 0.7) -> Column:
    """The last character that at least `share` (over a half) of the non-blank lines have in common; null below two lines."""
    own = F.filter(F.transform(lines(c), trim_ws), lambda x: x != "")
    last = F.transform(own, lambda x: F.right(x, F.lit(1)))
    n = F.size(last)
    # what more than half have is in the middle once sorted
    middle = F.get(F.array_sort(last), F.floor(n / 2).cast("int"))
    return F.when((n >= 2) & (n - F.size(F.array_remove(last, middle)) >= share * n), middle)


def numbered_verses(c) -> Column:
    """Text between number marks; each part's lines joined by tabs; blank parts are left out."""
    parts = F.filter(F.transform(F.split(col(c), NUMBER_MARK), trim_ws), lambda x: x != "")
    return F.transform(parts, lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), trim_ws), lambda x: x != ""), "\t"))


def first_lines(c, n: int) -> Column:
    return F.array_join(F.slice(lines(c), 1, n), "\n")


def drop_first_line(c) -> Column:
    own = lines(c)
    return F.array_join(F.slice(own, 2, F.size(own)), "\n")


def cut_at(n, percent) -> Column:
    """How many of n lines come before the cut: the percentage rounded down, at least 1 and at most n - 1."""
    return F.greatest(F.lit(1), F.least(F.floor(n * percent / 100).cast("int"), n - 1))


def continuation(c, percent) -> Column:
    """(given, rest) of the non-blank lines, cut at a percentage; null below two lines."""

    def parts(own):
        n = F.size(own)
        k = cut_at(n, percent)
        return F.when(n >= 2, F.struct(F.array_join(F.slice(own, F.lit(1), k), "\n").alias("given"), F.array_join(F.slice(own, k + 1, n), "\n").alias("rest")))

    # as the variable of a lambda the lines are found once
    return F.get(F.transform(F.array(full_lines(c)), parts), 0)


def window(c, start, size) -> Column:
    """`size` lines from line `start` (from 0) on."""
    return F.array_join(F.slice(lines(c), start + 1, size), "\n")


def repeats_lines(c, least: int = 5) -> Column:
    """More than `least` lines, and not all different."""
    own = full_lines(c)
    return (F.size(own) > least) & (F.size(own) > F.size(F.array_distinct(own)))
