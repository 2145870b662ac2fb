"""One notion of a missing value for all operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, col, trim_ws

# Spellings of a missing value, compared in lower case after trimming.
SPELLINGS = ("", "empty", "nan", "none", "<na>")
EMPTY_CONTAINERS = ("[]", "[ ]", "{}")


#: A whole value that is blank or a spelling of nothing. Possessive runs make a match end at the
#: first character that fits neither, however long the value.
NOTHING = f"^{WS}*+(?:(?i:{'|'.join(x for x in SPELLINGS if x)})|{'|'.join(re.escape(x) for x in EMPTY_CONTAINERS)})?{WS}*+$(?!\n)"


def is_missing(c) -> Column:
    """Null, blank, or a spelling of nothing."""
    c = col(c).cast("string")
    return c.isNull() | c.rlike(NOTHING)


def nullify(df: DataFrame, *columns: str) -> DataFrame:
    """Missing values of string columns (all of them by default) become nulls."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(~is_missing(n), F.col(n)) for n in names})


def filled(*columns: str) -> Column:
    """How many of the columns a row has a value in."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))


def strip_strings(df: DataFrame) -> DataFrame:
    """All string columns without white space at their ends; nulls stay nulls."""
    return df.withColumns({f.name: trim_ws(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Absent columns are added as null strings."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns}) if set(names) - set(df.columns) else df


def same(a, b) -> Column:
    """Null-safe equality of the trimmed strings."""
    return trim_ws(col(a).cast("string")).eqNullSafe(trim_ws(col(b).cast("string")))


def combined(new, old) -> Column:
    """The new value, or the old one where it is null."""
    return F.coalesce(col(new), col(old))
