"""Sinks. Every one goes through Spark's commit protocol; none gathers rows on the driver but the small reports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name
from . import named
from .workbook import write_sheet

LONG_CONTEXT = 8000  # tokens from which a sample counts as long


def delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    """With a header; white space at the ends of fields stays."""
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def instructions(df: DataFrame, path: str, instruction: str = "input", output: str = "output", mode: str = "overwrite") -> None:
    """JSON lines {instruction, input: '', output}."""
    df.select(F.col(instruction).alias("instruction"), F.lit("").alias("input"), F.col(output).alias("output")).write.mode(mode).option("ignoreNullFields", False).json(path)


def records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with every field, nulls too."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def partitioned(df: DataFrame, path: str, *by: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """A folder per value of the given columns."""
    df.write.mode(mode).partitionBy(*by).format(fmt).save(path)


def by_key(df: DataFrame, path: str, key: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """A folder per key, with names that are safe for file systems."""
    partitioned(df.withColumn("template_key", safe_name(key)), path, "template_key", fmt=fmt, mode=mode)


def routed(df: DataFrame, tokens: str = "num_tokens", threshold: int = LONG_CONTEXT) -> DataFrame:
    """df with context: LongContext from the threshold on, else ShortContext."""
    return df.withColumn("context", F.when(F.col(tokens) >= threshold, "LongContext").otherwise("ShortContext"))


def by_context(df: DataFrame, path: str, tokens: str = "num_tokens", threshold: int = LONG_CONTEXT, mode: str = "overwrite") -> None:
    partitioned(routed(df, tokens, threshold), path, "context", "split", "task", mode=mode)


def json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The table as one JSON array in one file below path, for harnesses that read nothing else; see `named.one_array`."""
    named.vacant(df.sparkSession, path, mode)
    named.one_array(df, f"{path.rstrip('/')}/part-00000.json", mode)


REPORT = 10_000  # rows that a report shows at most; more are an error


def _report(df: DataFrame) -> list:
    rows = df.limit(REPORT + 1).collect()
    if len(rows) > REPORT:
        raise ValueError(f"a report has {REPORT} rows at most")
    return rows


def put(spark, path: str, data: bytes) -> None:
    """A small file at a path of any store that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def sheet(df: DataFrame, path: str, name: str = "Sheet1", widths: list[float] | None = None) -> None:
    """A small table as a workbook of one sheet, with column widths."""
    put(df.sparkSession, path, write_sheet(df.columns, [tuple(r) for r in _report(df)], name, widths))


def stats_text(templates: DataFrame, dialects: DataFrame, path: str | None = None) -> str:
    """Two sections of `key: count` lines, of small tables (key, n); written to path too, if there is one."""
    section = lambda title, df: "\n".join([title, *(f"{k}: {n}" for k, n in _report(df.orderBy(F.desc("n"), "key")))])
    text = section("Template Statistics", templates.select("key", "n")) + "\n\n" + section("Dialect Statistics", dialects.select("key", "n")) + "\n"
    if path is not None:
        put(templates.sparkSession, path, text.encode())
    return text


def latex_table(df: DataFrame, caption: str = "") -> str:
    """A small table in LaTeX."""

    def esc(v) -> str:
        shown = "" if v is None else f"{v:,}" if isinstance(v, int) else str(v)
        return "".join("\\" + c if c in "&%$#_{}" else c for c in shown)

    body = [" & ".join(map(esc, r)) + r" \\" for r in _report(df)]
    return "\n".join([r"\begin{table}", rf"\caption{{{esc(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", " & ".join(map(esc, df.columns)) + r" \\ \hline", *body, r"\end{tabular}", r"\end{table}"])


def with_predictions(path: str) -> str:
    """The name of a file's copy with predictions: the same ending, the mark before it."""
    stem, dot, ending = path.rpartition(".")
    return f"{stem}_with_predictions.{ending}" if dot and "/" not in ending else f"{path}_with_predictions"


def cached(spark, path: str, build, *key, force: bool = False) -> DataFrame:
    """The table kept under a path made of the key's parts, built first if it isn't there, or in any case by force."""
    at = "/".join([path.rstrip("/"), *map(str, key)])
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if force or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def versioned(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write beside older versions, under the time; returns the path."""
    path = f"{root.rstrip('/')}/{datetime.now(UTC):%Y%m%d_%H%M%S_%f}"
    df.write.format(fmt).save(path)
    return path
