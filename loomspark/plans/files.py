"""Queries that write documents in a format and read them back; their SQL tells the rows that must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators import enrich, templates
from ..operators.scratch import root
from ..sources import named, readers, writers
from .catalog import query


def place(t, name: str) -> str:
    return f"{root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, k AS kind, md5(coalesce(text, '')) AS h FROM documents, (VALUES ('csv'), ('tsv')) v(k)")
def delimited_files(t):
    rows, out = t.documents.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), None
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        path = f"{place(t, 'delimited')}.{kind}"
        writers.delimited(rows, path, sep)
        got = readers.load(t.spark, path, schema="doc_id long, lang string, text string").select("doc_id", "lang", F.lit(kind).alias("kind"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 0")
def tolerant_rows(t):
    """Every fourth line has a field too many."""
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), "lang", F.when(F.col("doc_id") % 4 == 0, F.lit("more")))
    path = place(t, "tolerant")
    t.documents.select(line.alias("value")).write.text(f"{path}-parts")
    named.join(t.spark, named.parts(t.spark, f"{path}-parts"), path, begin=b"doc_id\tlang\n")
    return readers.delimited(t.spark, path, "\t", tolerant=True, schema="doc_id long, lang string")


@query("SELECT 'Write in ' || lang || ', ' || doc_id AS instruction, '' AS input, md5(text) AS h FROM documents")
def instruction_lines(t):
    """Lines that are no JSON stand among the others."""
    path = place(t, "instructions")
    writers.instructions(t.documents.select(F.concat(F.lit("Write in "), "lang", F.lit(", "), F.col("doc_id").cast("string")).alias("input"), F.col("text").alias("output")), path)
    t.documents.select(F.concat(F.lit("no json "), F.col("doc_id").cast("string"))).write.mode("append").text(path)
    rows = readers.json_lines(t.spark, path, schema="instruction string, input string, output string")
    return rows.select("instruction", "input", F.md5("output").alias("h"))


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def json_records(t):
    path = place(t, "records")
    writers.records(t.labelled.select("doc_id", "lang", "quality"), path)
    return t.spark.read.schema(t.labelled.select("doc_id", "lang", "quality").schema).json(path)


@query("SELECT doc_id, lang, source FROM documents")
def json_array_document(t):
    path = place(t, "array")
    writers.json_array(t.documents.select("doc_id", "lang", "source"), path)
    return readers.json_document(t.spark, path, schema="doc_id long, lang string, source string")


@query("SELECT 'lang=' || lang AS dataset_name, doc_id, source FROM documents")
def dataset_folders(t):
    path = place(t, "datasets")
    writers.partitioned(t.documents.select("doc_id", "source", "lang"), path, "lang")
    return readers.datasets(t.spark, path, "json").select("dataset_name", "doc_id", "source")


@query("SELECT regexp_replace(source || '/' || lang || ', x', '[ ,/]', '_', 'g') AS template_key, count(*) AS n FROM documents GROUP BY 1")
def key_folders(t):
    path = place(t, "keys")
    writers.by_key(t.documents.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit(", x")).alias("k")), path, "k")
    return t.spark.read.json(path).groupBy("template_key").agg(F.count("*").alias("n"))


@query("SELECT lang AS genre, source AS era, 'a_' || lang AS poet_name, source AS poem_name, 'rows' || chr(10) || count(*) AS poem FROM documents GROUP BY lang, source")
def titled_text_files(t):
    """A file for each language and source, of which there are few."""
    root = place(t, "titled")
    for r in t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).collect():
        writers.put(t.spark, f"{root}/{r.lang}/{r.source}/a_{r.lang}_{r.source}.txt", f"rows\n{r.n}".encode())
    return readers.titled_files(t.spark, root)


@query("SELECT lang, source, CAST(count(*) AS VARCHAR) AS n, CAST(sum(n_chars) AS VARCHAR) AS chars FROM documents GROUP BY lang, source")
def workbook_rows(t):
    path = f"{place(t, 'sheet')}.xlsx"
    writers.sheet(t.documents.groupBy("lang", "source").agg(F.count("*").alias("N"), F.sum("n_chars").alias("Chars")), path, "counts", [8, 12])
    return readers.load(t.spark, path, name="counts")


@query("SELECT 'Template' AS section, lang || '__' || 'text' AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'Dialect', source, count(*) FROM documents GROUP BY source")
def statistics_file(t):
    path = f"{place(t, 'statistics')}.txt"
    count = lambda c: t.documents.groupBy(c.alias("key")).agg(F.count("*").alias("n"))
    writers.stats_text(count(F.concat("lang", F.lit("__text"))), count(F.col("source")), path)
    return templates.stats_lines(t.spark, path)


@query("SELECT CASE WHEN n_chars // 5 >= 400 THEN 'LongContext' ELSE 'ShortContext' END AS context, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, lang AS task, count(*) AS n FROM documents GROUP BY 1, 2, 3")
def context_files(t):
    path = place(t, "contexts")
    rows = t.documents.select("doc_id", F.floor(F.col("n_chars") / 5).alias("num_tokens"), F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"), F.col("lang").alias("task"))
    writers.by_context(rows, path, threshold=400)
    return t.spark.read.json(path).groupBy("context", "split", "task").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def cached_table(t):
    """Built for 'en', read from the cache, then built anew by force for both."""
    path = place(t, "cache")
    build = lambda *langs: lambda: t.documents.where(F.col("lang").isin(*langs)).select("doc_id", "lang")
    writers.cached(t.spark, path, build("en"), "langs")
    writers.cached(t.spark, path, build("de"), "langs")
    kept = writers.cached(t.spark, path, build("de"), "langs").where("lang = 'en'")
    return kept.unionByName(writers.cached(t.spark, path, build("fr"), "more", force=True))


@query("SELECT v, lang, count(*) AS n FROM documents, (VALUES (1), (2)) x(v) WHERE v = 1 OR lang = 'en' GROUP BY v, lang")
def versioned_table(t):
    root = place(t, "versions")
    one = writers.versioned(t.documents.select("lang"), root)
    two = writers.versioned(t.documents.where("lang = 'en'").select("lang"), root)
    parts = [t.spark.read.parquet(p).withColumn("v", F.lit(k)) for k, p in ((1, one), (2, two))]
    return parts[0].unionByName(parts[1]).groupBy("v", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'reply to ' || doc_id AS model_generation FROM documents")
def resumed_completions(t):
    """A first run does a part and stops; the second does what is missing, in three saves."""
    path = place(t, "completions")
    todo = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("prompt"))
    step = lambda rows: enrich.complete(rows, "prompt", enrich.with_retries(lambda asked: [f"reply to {p}" for p in asked]), most=100).select("doc_id", "model_generation")
    enrich.resume(todo.where("doc_id % 3 = 0"), path, "doc_id", step)
    return enrich.resume(todo, path, "doc_id", step, saves=3)


@query("SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents")
def text_widths_of_csv(t):
    """White space at a field's ends survives the file."""
    path = place(t, "padded")
    writers.delimited(t.documents.select("doc_id", F.concat(F.lit("  "), F.replace(F.col("text"), F.lit("\r"), F.lit(" ")), F.lit(" ")).alias("text")), path)
    got = readers.delimited(t.spark, path, "\t", schema="doc_id long, text string")
    return got.select("doc_id", (F.size(F.split("text", " ")) - 3).cast("long").alias("n"))


@query("""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT replace(source || '_x', '_', '\\_') || ' & ' || format('{:,}', n) || ' & 50\\% \\\\' AS line FROM c
UNION ALL SELECT l FROM (VALUES ('\\begin{table}'), ('\\caption{Rows \\& more}'), ('\\begin{tabular}{lll}'), ('name & rows & part \\\\ \\hline'), ('\\end{tabular}'), ('\\end{table}')) v(l)
""")
def latex_lines(t):
    """A small table in LaTeX, line by line."""
    rows = t.documents.groupBy(F.concat("source", F.lit("_x")).alias("name")).agg((F.count("*")).cast("int").alias("rows")).withColumn("part", F.lit("50%"))
    shown = writers.latex_table(rows, "Rows & more")
    return t.spark.createDataFrame([(x,) for x in shown.split("\n")], "line string")


@query("SELECT doc_id, 'en: ' || doc_id AS prediction, 'test_with_predictions.tsv' AS file FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, NULL, 'test_with_predictions.tsv' FROM documents WHERE lang <> 'en' OR lang IS NULL")
def predictions_file(t):
    """E6x: a file's rows with a model's answers beside them, in a file named after it; null prompts have none."""
    path = f"{place(t, 'predicted')}/test.tsv"
    writers.delimited(t.documents.select("doc_id", F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).alias("prompt")), path)
    rows = readers.delimited(t.spark, path, "\t", schema="doc_id long, prompt string")
    to = writers.with_predictions(path)
    writers.delimited(enrich.complete(rows, "prompt", lambda asked: [f"en: {p}" for p in asked], "prediction").select("doc_id", "prediction"), to)
    got = readers.delimited(t.spark, to, "\t", schema="doc_id long, prediction string")
    return got.select("doc_id", "prediction", readers.path_part(1).alias("file"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0")
def hub_table(t):
    """A hub's cache holds a data set's files by split."""
    cache = place(t, "hub")
    for split, own in (("test", "doc_id % 10 = 0"), ("train", "doc_id % 10 <> 0")):
        t.documents.where(own).select("doc_id", "lang").coalesce(1).write.parquet(f"{cache}/{split}-parts")
        named.join(t.spark, named.parts(t.spark, f"{cache}/{split}-parts"), f"{cache}/owner/set/{split}-0.parquet")
    return readers.hub(t.spark, "owner/set", "train", cache)


@query("SELECT page_id, md5(regexp_replace(html, chr(13) || '?' || chr(10), ' ', 'g') || chr(10)) AS html_md5 FROM pages")
def page_files(t):
    """A file for each page, each a record."""
    root = place(t, "pages")
    named.file_per_row(t.pages.select("page_id", F.regexp_replace("html", "\r?\n", " ").alias("value")), "page_id", "value", root)
    files = readers.html_files(t.spark, root)
    return files.select(F.regexp_extract("path", "/(-?[0-9]+)(?:~[0-9]+)?\\.html$", 1).try_cast("long").alias("page_id"), F.md5("html").alias("html_md5"))


@query("SELECT lang, 't' || lang AS id, 'lang,source' AS inputs, 'text' AS output, 'Write in ' || lang || '.' AS text FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT lang, 't' || lang, 'lang,source', 'text', 'And: ' || lang FROM (SELECT DISTINCT lang FROM documents)")
def yaml_sheet(t):
    """A template for each language, of which there are few."""
    path = f"{place(t, 'yaml')}/templates.yaml"
    lines = [f"{r.lang}:\n- id: t{r.lang}\n  input: [lang, source]\n  output: text\n  text:\n  - Write in {r.lang}.\n  - 'And: {r.lang}'\n" for r in t.documents.select("lang").distinct().collect()]
    writers.put(t.spark, path, "".join(lines).encode())
    return readers.yaml_templates(t.spark, path).withColumn("inputs", F.array_join("inputs", ","))


@query("SELECT doc_id, format('{:,}', n_chars * 1000) AS shown, 'Poem ' || upper(lang[1]) || lang[2:] || ', Era → Full Text' AS name FROM documents")
def display_names(t):
    """numbers and template keys as readers would have them."""
    key = F.concat(F.lit("poem_"), "lang", F.lit("__era___full_text"))
    return t.documents.select("doc_id", text.thousands(F.col("n_chars") * 1000).alias("shown"), text.display_name(key).alias("name"))
