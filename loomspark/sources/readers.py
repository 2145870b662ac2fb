"""Scans: delimited text, JSON, whole files, directories of data sets, templates."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workbook import read_sheet


def delimited(spark: SparkSession, path, sep: str = ",", tolerant: bool = False, schema=None) -> DataFrame:
    """CSV or TSV with a header; fields may hold newlines and doubled quotes.

    tolerant: rows with too many or too few fields are left out, otherwise they fail.
    Types are inferred from the whole input unless a schema is given, which a large scan should do.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def json_lines(spark: SparkSession, path, schema=None, tolerant: bool = True) -> DataFrame:
    """A JSON object a line; lines that are none are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_document(spark: SparkSession, path, schema=None) -> DataFrame:
    """Files that are one JSON value each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the path's ending: csv, tsv, json, jsonl, parquet, xlsx; any other is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    match kind:
        case "csv":
            return delimited(spark, path, ",", **options)
        case "tsv":
            return delimited(spark, path, "\t", **options)
        case "json":
            return json_document(spark, path, **options)
        case "jsonl":
            return json_lines(spark, path, **options)
        case "parquet":
            return spark.read.parquet(path)
        case "xlsx" | "xls":
            return sheet(spark, path, **options)
    raise ValueError(f"unsupported file type: .{kind}")


def sheet(spark: SparkSession, path: str, name: str | int = 0) -> DataFrame:
    """A small sheet of a workbook, such as templates, as strings; column names are trimmed and lower-cased."""
    rows = read_sheet(spark.read.format("binaryFile").load(path).first()["content"], name)
    header = [(c or f"column {k}").strip().lower() for k, c in enumerate(rows[0])] if rows else []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.createDataFrame([r for r in rows[1:] if any(x is not None for x in r)], schema)


def yaml_templates(spark: SparkSession, path: str) -> DataFrame:
    """(lang, id, inputs, output, text): a small YAML file of templates by language; one row per text. Needs yaml."""
    import yaml

    found = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}
    rows = []
    for lang, templates in found.items():
        for t in templates:
            out = t.get("output")
            for text in t.get("text") or []:
                rows.append((lang, str(t.get("id")), list(t.get("input") or []), ",".join(out) if isinstance(out, list) else out, text))
    return spark.createDataFrame(rows, "lang string, id string, inputs array<string>, output string, text string")


def path_part(level: int) -> Column:
    """A folder of the row's file, counted from the file (1: its own folder)."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.url_decode(F.replace(F.try_element_at(parts, F.lit(-1 - level)), F.lit("+"), F.lit("%2B")))


def datasets(spark: SparkSession, root: str, fmt: str = "csv", **options) -> DataFrame:
    """All data sets below a folder, one sub-folder each, whose name is dataset_name."""
    own = {"header": True, "multiLine": True, "escape": '"'} if fmt == "csv" else {}
    reader = spark.read.options(**own | options)
    return reader.format(fmt).load(f"{root.rstrip('/')}/*/").withColumn("dataset_name", path_part(1))


def titled_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole files genre/era/<poet>_<title>.<ext>: the name is split at its last underscore; files without one are left out."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    stem = F.regexp_replace(path_part(0), r"\.[^.]*$", "")
    rows = files.select(path_part(2).alias("genre"), path_part(1).alias("era"), stem.alias("stem"), F.col("value").alias("poem"))
    rows = rows.where(F.instr("stem", "_") > 0)
    return rows.select("genre", "era", F.regexp_extract("stem", "^(.*)_", 1).alias("poet_name"), F.regexp_extract("stem", "_([^_]*)$", 1).alias("poem_name"), "poem")


def html_files(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """(path, html) of every file, sorted by path. Read as bytes, as whole texts cost a search for codecs a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("html")).orderBy("path")


def hub(spark: SparkSession, name: str, split: str = "train", cache: str | None = None) -> DataFrame:
    """A data set of a hub. cache: a folder that holds its Parquet files as <name>/<split>*; without one the `datasets` library fetches it."""
    if cache is not None:
        return spark.read.option("pathGlobFilter", f"{split}*").option("recursiveFileLookup", True).parquet(f"{cache.rstrip('/')}/{name}")
    try:
        import datasets as library
    except ImportError as e:
        raise RuntimeError("name a folder that holds the data set, or install the datasets library") from e
    return spark.createDataFrame(library.load_dataset(name, split=split).to_pandas())


def fetched(todo: DataFrame, url: str, get, tries: int = 3, wait: float = 1.0, key: str = "id") -> DataFrame:
    """(key, url, status, body): pages of a work list. url: a pattern with {id}; get: a function of a URL to (status, body).

    A page that fails is tried again after twice the time before; 404 is an answer, with
    no body; what fails to the end has status -1, so that a later run's work list holds it.
    """

    def one(at: str):
        for k in range(tries):
            try:
                status, body = get(at)
                if status == 404:
                    return status, None
                if status < 400:
                    return status, body
            except OSError:
                pass
            if k + 1 < tries:
                time.sleep(wait * 2**k)
        return -1, None

    def run(parts):
        for part in parts:
            urls = [url.format(id=i) for i in part[key]]
            found = [one(u) for u in urls]
            yield part[[key]].assign(url=urls, status=[s for s, _ in found], body=[b for _, b in found])

    return todo.select(key).mapInPandas(run, f"`{key}` {dict(todo.dtypes)[key]}, url string, status int, body string")


def latest(df: DataFrame, group: str, path: str = "path", pattern: str = r"checkpoint-([0-9]+)") -> DataFrame:
    """Each group's path with the largest number in it; the last by name among equals or where none has a number."""
    number = F.regexp_extract(F.col(path), pattern, 1).try_cast("long")
    return df.groupBy(group).agg(F.max_by(path, F.struct(F.coalesce(number, F.lit(-1)), F.col(path))).alias(path))


def work_list(spark: SparkSession, first: int, last: int, done: DataFrame, key: str = "id") -> DataFrame:
    """Ids of a range that are not done yet."""
    return spark.range(first, last + 1).withColumnRenamed("id", key).join(done.select(key), key, "left_anti")
