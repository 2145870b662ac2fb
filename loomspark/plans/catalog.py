"""All queries over the driver's tables, by name, each with DuckDB SQL for the same rows.

documents stand for texts with lines, labels for sparse metadata, benchmark for a
held-out split, pages for scraped HTML, conversations for chats.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines, missing, text, values
from ..operators import chat, dedup, enrich, evaluation, metrics, sampling, stats, templates
from ..sources import html, readers, writers
from ..streaming import events as streams
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LATIN = r"A-Za-z\x{00C0}-\x{024F}"
HELD = "doc_id % 10 = 0"  # the part of documents that stands for a test split


class Tables:
    """The tables of a folder, each read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    @property
    def labelled(self) -> DataFrame:
        """Documents with their labels, null where there are none."""
        return self.documents.join(self.labels, "doc_id", "left")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rows_of(spark: SparkSession, schema: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --- statistics -----------------------------------------------------------------------


@query(f"""
WITH r AS (SELECT source AS origin, CASE WHEN length({S.trim('text')}) > 0 THEN length(text) END AS c, len({S.lines('text')}) AS l FROM documents),
g AS (SELECT origin, count(*) AS samples, count(c) AS non_empty, sum(c) AS c, sum(l) AS l, count(l) AS nl FROM r GROUP BY origin)
SELECT origin, samples, non_empty, CAST(c AS BIGINT) / non_empty AS avg_chars, l::DOUBLE / nl AS avg_lines FROM g
UNION ALL SELECT 'TOTAL', CAST(sum(samples) AS BIGINT), CAST(sum(non_empty) AS BIGINT), CAST(sum(c) AS BIGINT) / CAST(sum(non_empty) AS BIGINT), sum(l * samples / nl)::DOUBLE / CAST(sum(samples) AS BIGINT) FROM g
""")
def corpus_origin_stats(t):
    return stats.origins(t.documents, F.col("source"), "text")


@query(f"""
WITH r AS (SELECT source AS origin, CASE WHEN length({S.trim('text')}) > 0 THEN length(text) END AS c, len({S.lines('text')}) AS l FROM documents),
g AS (SELECT origin, count(*) AS samples, count(c) AS non_empty, round(CAST(sum(c) AS BIGINT) / count(c), 2) AS a, round(sum(l)::DOUBLE / count(l), 2) AS b FROM r GROUP BY origin)
SELECT origin, samples, non_empty, a AS avg_chars, b AS avg_lines FROM g
UNION ALL SELECT 'TOTAL', CAST(sum(samples) AS BIGINT), CAST(sum(non_empty) AS BIGINT), round(sum(a * non_empty) / sum(non_empty), 2), round(sum(b * samples) / sum(samples), 2) FROM g
""")
def corpus_origin_stats_rounded(t):
    """A2: TOTAL from the groups' rounded averages, as in a printed table."""
    return stats.origins(t.documents, F.col("source"), "text", digits=2)


@query("""
SELECT CASE WHEN lang = 'en' THEN 'web_' || source ELSE lang END AS origin, count(*) AS samples, count(text) AS non_empty,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1
""")
def nested_origin_stats(t):
    origin = stats.nested_origin("lang", "en", "source", "web")
    return t.documents.groupBy(origin.alias("origin")).agg(F.count("*").alias("samples"), F.count("text").alias("non_empty"), F.sum(F.length("text")).alias("chars"))


@query("SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def corpus_totals(t):
    return t.documents.agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars"))


@query("""
SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es
FROM documents GROUP BY source
""")
def lang_source_pivot(t):
    return stats.pivot_counts(t.documents, "source", "lang", ["en", "fr", "de", "es"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({S.missing(c)}) AS n_missing, count(*) AS n_rows FROM documents LEFT JOIN labels USING (doc_id)" for c in ("text", "lang", "source", "quality", "toxic")))
def missing_counts(t):
    return stats.missing_counts(t.labelled, "text", "lang", "source", "quality", "toxic")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) * 100.0::DOUBLE / count(*) AS pct FROM documents LEFT JOIN labels USING (doc_id)" for c in ("text", "quality", "toxic")))
def completion_pct(t):
    return stats.completion(t.labelled, "text", "quality", "toxic")


@query("SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def value_counts_with_null(t):
    return stats.value_counts(t.labelled, "quality", with_null=True)


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(t):
    return stats.value_counts(t.documents, "lang")


@query(f"""
WITH d AS (SELECT {S.hard('text')} AS t FROM documents), g AS (SELECT t, count(*) AS n FROM d WHERE t <> '' GROUP BY t)
SELECT (SELECT count(*) FROM d) AS total, CAST(sum(n) AS BIGINT) AS non_empty, count(*) AS distinct_texts, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_values FROM g
""")
def duplicate_stats(t):
    return stats.duplicates(t.documents, text.clean_hard("text"))


@query(f"SELECT md5(t) AS h, n FROM (SELECT {S.hard('text')} AS t, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 AND {S.hard('text')} <> '' ORDER BY n DESC, t LIMIT 10)".replace(f"AND {S.hard('text')} <> ''", "AND min(length(text)) > 0"))
def top_duplicates(t):
    return stats.top_duplicates(t.documents, text.clean_hard("text")).select(F.md5("t").alias("h"), "n")


@query(f"""
WITH a AS (SELECT DISTINCT {S.hard('text')} AS t FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT {S.hard('text')} AS t FROM documents WHERE doc_id % 2 = 0)
SELECT (SELECT count(*) FROM (SELECT t FROM a INTERSECT SELECT t FROM b)) AS shared, count(*) AS in_either,
  (SELECT count(*) FROM (SELECT t FROM a INTERSECT SELECT t FROM b)) * 100.0::DOUBLE / count(*) AS pct
FROM (SELECT t FROM a UNION SELECT t FROM b)
""")
def split_overlap(t):
    return stats.overlap(t.documents.where("lang = 'en'"), t.documents.where("doc_id % 2 = 0"), text.clean_hard("text"))


@query(f"SELECT source, count(*) AS n_rows, CAST(sum(len({S.words('text')})) AS BIGINT) AS n_words, CAST(sum(len({S.words('text')})) AS BIGINT) / count(*) AS words_per_row FROM documents GROUP BY source")
def word_totals(t):
    return stats.word_totals(t.documents, "text", "source")


@query(f"SELECT lang, count(*) AS n, min(len({S.lines('text')})) AS low, max(len({S.lines('text')})) AS high, CAST(sum(len({S.lines('text')})) AS BIGINT) AS total, CAST(sum(len({S.lines('text')})) AS BIGINT) / count(*) AS mean FROM documents GROUP BY lang")
def verse_spread(t):
    out = stats.spread(t.documents, lines.count_lines("text"), "lang")
    return out.withColumns({"low": F.col("low").cast("long"), "high": F.col("high").cast("long")})


@query(f"""
SELECT CASE WHEN v < 0 THEN 0 WHEN v >= 100 THEN 11 ELSE CAST(floor(v / 10.0) AS BIGINT) + 1 END AS bin, count(*) AS n
FROM (SELECT len({S.lines('text')}) - 1 AS v FROM documents) GROUP BY 1
""")
def verse_histogram(t):
    return stats.histogram(t.documents, lines.count_newlines("text"), 0, 100, 10)


_GRID = [0.0, 2.0, 5.0, 10.0, 20.0, 50.0]


@query(f"""
WITH v AS (SELECT (len({S.lines('text')}) - 1)::DOUBLE AS v FROM documents WHERE text IS NOT NULL),
o AS (SELECT count(*)::DOUBLE AS t, sum(v) AS s, sum(v * v) AS q FROM v), h AS (SELECT t, sqrt((q - s * s / t) / (t - 1)) * pow(t, -0.2) AS h FROM o)
SELECT x, round(sum(exp(-pow((x - v) / h, 2) / 2)) / (any_value(t) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM v, h, unnest({_GRID}::DOUBLE[]) g(x) GROUP BY x
""")
def verse_density(t):
    return stats.density(t.documents, lines.count_newlines("text"), _GRID).withColumn("density", F.round("density", 9))


@query("""
WITH top AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5)
SELECT source, lang, count(*) AS n FROM documents WHERE source IN (SELECT source FROM top) GROUP BY source, lang
""")
def topk_values_filter(t):
    return stats.top_values(t.documents, "source", 5).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query(f"""
WITH b AS (SELECT doc_id, {S.hard('text')} AS text, lang, source FROM documents), j AS (SELECT d.text AS ta, b.text AS tb, d.lang AS al, b.lang AS bl FROM documents d JOIN b USING (doc_id))
SELECT 'text' AS "column", count(*) FILTER ({S.trim('ta')} = {S.trim('tb')}) AS matches, count(*) FILTER ({S.trim('ta')} <> {S.trim('tb')}) AS differences, count(*) FILTER ({S.trim('ta')} = {S.trim('tb')}) * 100.0::DOUBLE / count(*) AS pct FROM j
UNION ALL SELECT 'lang', count(*) FILTER (al = bl), count(*) FILTER (al <> bl), count(*) FILTER (al = bl) * 100.0::DOUBLE / count(*) FROM j
""")
def null_safe_compare(t):
    return stats.column_equality(t.documents, t.documents.withColumn("text", text.clean_hard("text")), "doc_id", ["text", "lang"])


@query("SELECT lang FROM documents GROUP BY lang HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM documents)")
def pairwise_common_inputs(t):
    sources = t.documents.select("source").distinct().count()
    return stats.in_all(t.documents, "lang", "source", sources)


# --- text -----------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({S.hard('text')}) AS h, length({S.hard('text')}) AS n FROM documents")
def text_clean_hard(t):
    c = text.clean_hard("text")
    return t.documents.select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({S.light('text')}) AS h, length({S.light('text')}) AS n FROM documents")
def text_clean_light(t):
    c = text.clean_light("text")
    return t.documents.select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({S.unmarked('text')}) AS narrow, md5({S.unmarked('text', True)}) AS wide, regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') AS arabic, md5({S.collapse('text')}) AS collapsed FROM documents")
def text_marks(t):
    return t.documents.select("doc_id", F.md5(text.strip_marks("text")).alias("narrow"), F.md5(text.strip_marks("text", True)).alias("wide"), text.has_script("text").alias("arabic"), F.md5(text.clean_text("text")).alias("collapsed"))


@query(f"SELECT doc_id, md5({S.signature('text')}) AS sig, {S.bucket('text')} AS bucket FROM documents")
def token_signature(t):
    return t.documents.select("doc_id", F.md5(text.token_signature("text")).alias("sig"), text.bucket(text.token_signature("text")).alias("bucket"))


@query(f"SELECT doc_id, len({S.lines('text')}) AS a, len({S.full_lines('text')}) AS b, length(text) - length(replace(text, chr(10), '')) AS c FROM documents")
def verse_counts(t):
    return t.documents.select("doc_id", *(f("text").cast("long").alias(n) for n, f in (("a", lines.count_lines), ("b", lines.count_full_lines), ("c", lines.count_newlines))))


@query(f"""
WITH d AS (SELECT doc_id, {S.lines('text')} AS l FROM documents)
SELECT doc_id, CAST(len(l) // 2 AS BIGINT) AS pairs,
  md5(array_to_string(list_transform(range(0, len(l) // 2), lambda k: l[2 * k + 1] || chr(9) || l[2 * k + 2]), chr(10))) AS dropped,
  md5(array_to_string(list_transform(range(0, (len(l) + 1) // 2), lambda k: l[2 * k + 1] || chr(9) || coalesce(l[2 * k + 2], '')), chr(10))) AS padded,
  md5(CASE WHEN len(l) % 2 = 0 THEN array_to_string(list_transform(range(0, len(l) // 2), lambda k: l[2 * k + 1] || chr(9) || l[2 * k + 2]), chr(10)) ELSE array_to_string(l, chr(10)) END) AS leaving
FROM d
""")
def hemistich_pairs(t):
    return t.documents.select("doc_id", F.size(lines.line_pairs("text")).cast("long").alias("pairs"), F.md5(lines.pair_lines("text")).alias("dropped"), F.md5(lines.pair_lines("text", "pad")).alias("padded"), F.md5(lines.pair_lines("text", "leave")).alias("leaving"))


@query(f"""
WITH d AS (SELECT doc_id, list_transform(list_filter(list_transform({S.lines('text')}, lambda l: {S.trim('l')}), lambda l: l <> ''), lambda l: right(l, 1)) AS e FROM documents)
SELECT doc_id, CASE WHEN len(e) >= 2 THEN list_filter(list_distinct(e), lambda c: len(list_filter(e, lambda x: x = c)) >= 0.7 * len(e))[1] END AS rhyme FROM d
""")
def detect_rhyme(t):
    return t.documents.select("doc_id", lines.ending("text").alias("rhyme"))


@query(f"SELECT doc_id, len({S.full_lines('text')}) > 5 AND len({S.full_lines('text')}) > len(list_distinct({S.full_lines('text')})) AS repeated FROM documents")
def repeated_lines_flag(t):
    return t.documents.select("doc_id", lines.repeats_lines("text").alias("repeated"))


@query(f"SELECT doc_id, md5({S.trim('string_split(text, chr(45))[1]')}) AS head, regexp_replace(source || '/' || lang, '[ ,/]', '_', 'g') AS name, CAST(floor((length(text) + length(lang)) / 4) AS BIGINT) AS tokens, try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT) AS first_number FROM documents")
def scalar_functions(t):
    return t.documents.select("doc_id", F.md5(text.before_dash("text")).alias("head"), text.safe_name(F.concat_ws("/", "source", "lang")).alias("name"), text.token_estimate("text", "lang").alias("tokens"), values.first_integer("text").alias("first_number"))


@query(f"SELECT doc_id, regexp_replace(text, '[^{LATIN}{S.WS[1:-1]}]', '', 'g') = text AS only_letters, md5(regexp_replace(text, '[^{LATIN}{S.WS[1:-1]}]', '', 'g')) AS h, md5(regexp_replace(text, '^{S.WS}*[0-9]+\\.{S.WS}*', '')) AS unnumbered FROM documents")
def script_filter(t):
    c = text.only_script("text", LATIN)
    return t.documents.select("doc_id", (c == F.col("text")).alias("only_letters"), F.md5(c).alias("h"), F.md5(text.strip_numbering("text")).alias("unnumbered"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang || '، ' || source || '، وx' WHEN 1 THEN lang WHEN 2 THEN '' WHEN 3 THEN source || '، و' || lang WHEN 4 THEN source ELSE 'it''s، و' || lang END AS phrase FROM documents
""")
def naturalized_lists(t):
    made = F.expr("""CASE doc_id % 6 WHEN 0 THEN concat('["', lang, '","', source, '","x"]') WHEN 1 THEN concat("['", lang, "']") WHEN 2 THEN '[]'
        WHEN 3 THEN concat('["', source, '", "', lang, '", " "]') WHEN 4 THEN source ELSE concat("['it\\\\'s', '", lang, "']") END""")
    return t.documents.select("doc_id", values.naturalize(made, literals=True).alias("phrase"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'بحر ' || source WHEN 1 THEN 'بحر ' || source WHEN 2 THEN NULL WHEN 3 THEN 'بحر ' || lang END AS meter,
  CASE doc_id % 4 WHEN 0 THEN 'العصر الحديث' WHEN 1 THEN NULL WHEN 2 THEN 'العصر الأيوبي' ELSE source END AS era FROM documents
""")
def normal_names(t):
    m = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('البحر  ', source) WHEN 1 THEN concat(' ', source, ' ') WHEN 2 THEN 'بحر nan' WHEN 3 THEN concat('بحر ', lang) ELSE '' END")
    e = F.expr("CASE doc_id % 4 WHEN 0 THEN 'الحديث' WHEN 1 THEN 'غير محدد' WHEN 2 THEN 'الدولة الايوبية' ELSE source END")
    return t.documents.select("doc_id", values.normal_meter(m).alias("meter"), values.normal_era(e).alias("era"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.page') AS page, len(json_keys(props)) AS n_keys FROM events")
def json_props(t):
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", "event_type", F.try_element_at(m, F.lit("page")).alias("page"), F.size(F.map_keys(m)).cast("long").alias("n_keys"))


@query("SELECT doc_id, doc_id % 7 AS prompt, doc_id AS row FROM documents WHERE doc_id % 3 <> 1")
def reply_ids(t):
    made = F.expr("CASE WHEN doc_id % 3 = 1 THEN concat('p', doc_id, 'r', doc_id) ELSE concat('p', doc_id % 7, '_r', doc_id) END")
    return t.documents.withColumn("x", values.row_number_id(made)).where("x is not null").select("doc_id", "x.prompt", "x.row")


_BODY = "'{\"a\":' || doc_id || ',\"lang\":\"' || lang || '\"}'"


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN {_BODY} END AS body FROM documents")
def fenced_json(t):
    own = F.expr(_BODY)
    made = F.expr("doc_id % 5")
    reply = F.when(made == 0, F.concat(F.lit("```json "), own, F.lit(" ```"))).when(made == 1, F.concat(F.lit("x ```\n"), own, F.lit("\n```"))).when(made == 2, F.concat(F.lit('\"\"\"'), own, F.lit('\"\"\"'))).when(made == 3, F.concat(F.lit("so "), own, F.lit("."))).otherwise(F.col("lang"))
    return t.documents.select("doc_id", values.fenced(reply).alias("body"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'qwen3-random' WHEN 1 THEN 'checkpoint-' || doc_id WHEN 2 THEN 'llama-' || lang ELSE 'jais-' || source || '-curriculum' END AS name FROM documents")
def model_names(t):
    path = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(source, '/Qwen3-8B/random/4tasks/checkpoint-', doc_id) WHEN 1 THEN concat(source, '/', lang, '/checkpoint-', doc_id) WHEN 2 THEN concat('Llama-7B-Instruct-', lang, '/last') ELSE concat('x/jais-', source, '-8b/curriculum/checkpoint-1') END")
    return t.documents.select("doc_id", text.model_name(path).alias("name"))


# --- duplicates and contamination -----------------------------------------------------



@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {S.hard('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup_keep_first(t):
    return dedup.exact(t.documents, "text", "doc_id").select("doc_id")


@query(f"""
WITH r AS (SELECT doc_id, {S.bucket('text')} AS b, (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY b ORDER BY n DESC, doc_id) AS rn FROM r) WHERE rn = 1
""")
def bucket_dedup_best(t):
    return dedup.keep_fullest(t.labelled, text.bucket(text.token_signature("text")), "doc_id", ["quality", "toxic"]).select("doc_id")


#: Similarity of the pairs p (id, a, b): r holds the common subsequences of a's beginning with each beginning of b.
_SIMILAR = """
l(id, i, r) AS (
  SELECT id, 0, list_transform(range(length(b) + 1), lambda j: 0) FROM p
  UNION ALL
  SELECT l.id, l.i + 1, list_transform(range(length(p.b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda q: greatest(l.r[q + 1], CASE WHEN q > 0 AND p.b[q] = p.a[l.i + 1] THEN l.r[q] + 1 ELSE 0 END))))
  FROM l JOIN p USING (id) WHERE l.i < length(p.a)),
similar_ AS (SELECT p.*, 2 * l.r[length(p.b) + 1] / (length(p.a) + length(p.b))::DOUBLE AS s FROM l JOIN p USING (id) WHERE l.i = length(p.a))
"""
_HEADS = f"""
d AS (SELECT doc_id AS k, text AS t, {S.bucket('text')} AS bucket, (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT {S.missing('text')}),
first_ AS (SELECT *, row_number() OVER (PARTITION BY bucket, t ORDER BY n DESC, k) AS rn, first_value(k) OVER (PARTITION BY bucket, t ORDER BY n DESC, k) AS kept FROM d),
p AS (SELECT row_number() OVER () AS id, x.bucket, x.k AS i, y.k AS j, x.n AS ni, y.n AS nj, x.t AS a, y.t AS b FROM first_ x JOIN first_ y ON x.bucket = y.bucket AND x.k < y.k WHERE x.rn = 1 AND y.rn = 1)
"""
#: The pairs of a bucket in order; one that is gone meets no other.
_LOG = f"""
WITH RECURSIVE {_HEADS}, {_SIMILAR},
c AS (SELECT bucket, i, j, ni, nj, s, row_number() OVER (PARTITION BY bucket ORDER BY i, j) AS step FROM similar_ WHERE s >= 0.9),
g(bucket, step, gone, log) AS (
  SELECT DISTINCT bucket, 0::BIGINT, []::BIGINT[], []::STRUCT(kept BIGINT, dropped BIGINT, similarity DOUBLE)[] FROM c
  UNION ALL
  SELECT g.bucket, c.step, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, CASE WHEN ni >= nj THEN j ELSE i END) END,
    CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN log WHEN ni >= nj THEN list_append(log, {{'kept': i, 'dropped': j, 'similarity': s}}) ELSE list_append(log, {{'kept': j, 'dropped': i, 'similarity': s}}) END
  FROM g JOIN c ON c.bucket = g.bucket AND c.step = g.step + 1),
log_ AS (
  SELECT kept, k AS dropped, 1.0::DOUBLE AS similarity FROM first_ WHERE rn > 1
  UNION ALL SELECT x.kept, x.dropped, x.similarity FROM (SELECT unnest(log) AS x FROM g WHERE (bucket, step) IN (SELECT (bucket, max(step)) FROM c GROUP BY bucket)))
"""
_TEXTS = f"x AS (SELECT doc_id AS k, text AS t, {S.bucket('text')} AS bucket, {HELD} AS held FROM documents WHERE NOT {S.missing('text')}), e AS (SELECT DISTINCT bucket, t FROM x WHERE held)"


def _crossed(on: str) -> str:
    """Train rows that neither equal a test text nor are near one; on: which test texts those that share a bucket with any meet."""
    return f"""
WITH RECURSIVE {_TEXTS},
m AS (SELECT * FROM x WHERE NOT held AND bucket IN (SELECT bucket FROM e) AND t NOT IN (SELECT t FROM e)),
p AS (SELECT row_number() OVER () AS id, m.k, m.t AS a, e.t AS b FROM m JOIN e ON {on} WHERE 2 * least(length(m.t), length(e.t)) >= 0.9::DOUBLE * (length(m.t) + length(e.t))), {_SIMILAR}
SELECT doc_id FROM documents WHERE NOT coalesce({HELD}, FALSE) AND doc_id NOT IN (SELECT k FROM similar_ WHERE s >= 0.9 UNION ALL SELECT k FROM x WHERE NOT held AND t IN (SELECT t FROM e))
"""


@query(_LOG + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT dropped FROM log_)")
def fuzzy_block_dedup(t):
    return dedup.near_exact(t.labelled, "text", "doc_id", ["quality", "toxic"]).select("doc_id")


@query(_LOG + "SELECT * FROM log_")
def fuzzy_match_log(t):
    return dedup.match_log(t.labelled, "text", "doc_id", ["quality", "toxic"])


@query(f"WITH RECURSIVE {_HEADS}, {_SIMILAR} SELECT v.t::DOUBLE AS threshold, count(s) AS pairs FROM (VALUES (0.7), (0.9), (0.93), (0.95), (0.98)) v(t) LEFT JOIN similar_ ON s >= v.t::DOUBLE GROUP BY v.t")
def fuzzy_threshold_sweep(t):
    return dedup.sweep(t.documents, "text", "doc_id")


@query(_crossed("m.bucket = e.bucket"))
def fuzzy_cross_split(t):
    return dedup.cross_split(t.documents.where(f"NOT {HELD}"), t.documents.where(HELD), "text", "doc_id").select("doc_id")


@query(_crossed("TRUE"))
def fuzzy_cross_split_wide(t):
    return dedup.cross_split(t.documents.where(f"NOT {HELD}"), t.documents.where(HELD), "text", "doc_id", wide=True).select("doc_id")


@query()
def near_copy_pairs(t):
    return dedup.near_copies(t.documents.where(f"NOT {HELD}"), t.documents.where(HELD), "text", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT {HELD} AND {S.hard('text')} NOT IN (SELECT {S.hard('text')} FROM documents WHERE {HELD})")
def decontaminate_exact(t):
    return dedup.decontaminate(t.documents.where(f"NOT {HELD}"), t.documents.where(HELD), "text").select("doc_id")


@query(f"""
WITH b AS (SELECT DISTINCT {S.hard('text')} AS t FROM documents WHERE {HELD}), a AS (SELECT DISTINCT {S.hard('text')} AS t FROM documents WHERE NOT {HELD}), clean AS (SELECT t FROM a WHERE t NOT IN (SELECT t FROM b WHERE t IS NOT NULL))
SELECT count(*) AS left_over FROM clean JOIN b USING (t)
""")
def decontaminate_verified(t):
    clean = dedup.decontaminate(t.documents.where(f"NOT {HELD}"), t.documents.where(HELD), "text")
    return dedup.contamination_summary(clean, t.documents.where(HELD), "text").select(F.col("shared").alias("left_over"))


@query(f"""
SELECT a.doc_id AS train_doc_id, b.doc_id AS test_doc_id, md5(a.text) AS train_text, md5(b.text) AS test_text
FROM documents a JOIN documents b ON {S.hard('a.text')} = {S.hard('b.text')} WHERE a.doc_id % 10 <> 0 AND b.doc_id % 10 = 0
""")
def contamination_report(t):
    out = dedup.contamination_report(t.documents.where(f"NOT {HELD}"), t.documents.where(HELD), "text", ["doc_id"])
    return out.select("train_doc_id", "test_doc_id", F.md5("train_original_text").alias("train_text"), F.md5("test_original_text").alias("test_text"))


@query(f"""
WITH a AS (SELECT DISTINCT {S.hard('text')} AS t FROM documents WHERE NOT {HELD}), b AS (SELECT DISTINCT {S.hard('text')} AS t FROM documents WHERE {HELD}), s AS (SELECT count(*) AS n FROM a JOIN b USING (t))
SELECT (SELECT count(*) FROM a) AS train_texts, (SELECT count(*) FROM b) AS test_texts, n AS shared, n * 100.0::DOUBLE / (SELECT count(*) FROM a) AS pct_of_train, n * 100.0::DOUBLE / (SELECT count(*) FROM b) AS pct_of_test FROM s
""")
def contamination_summary(t):
    return dedup.contamination_summary(t.documents.where(f"NOT {HELD}"), t.documents.where(HELD), "text")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def decontaminate_contains(t):
    return dedup.containing(t.documents, t.benchmark, "text", "doc_id", "text", "item_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabelled(t):
    return enrich.pending(t.documents, t.labels, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_labelled(t):
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id")


@query("SELECT i AS doc_id FROM range((SELECT min(doc_id) FROM documents), (SELECT max(doc_id) FROM documents) + 1) r(i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def resume_worklist(t):
    first, last = t.documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    return readers.work_list(t.spark, first, last, t.labels, "doc_id")


# --- sampling and assignment ----------------------------------------------------------


@query(f"SELECT doc_id FROM documents ORDER BY {S.draw('doc_id')}, doc_id LIMIT 100")
def deterministic_sample(t):
    return sampling.sample(t.documents.select("doc_id"), 100, "doc_id")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {S.draw('doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 3")
def sample_per_group(t):
    return sampling.sample_per_group(t.documents.select("source", "doc_id"), 3, "source", "doc_id")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {S.draw('doc_id')}, doc_id) AS pos FROM documents")
def shuffle_positions(t):
    return sampling.positions(t.documents.select("doc_id"), "doc_id")


@query(f"""
WITH w(source, weight) AS (VALUES ('src0', 0.5::DOUBLE), ('src1', 0.25::DOUBLE), ('src2', 1.0::DOUBLE)),
r AS (SELECT doc_id, source, floor(count(*) OVER (PARTITION BY source) * weight) AS n, row_number() OVER (PARTITION BY source ORDER BY {S.draw('doc_id')}, doc_id) AS rn FROM documents JOIN w USING (source))
SELECT doc_id, source, CASE WHEN rn <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r WHERE rn <= n
""")
def mixture_weighted(t):
    return sampling.mixture(t.documents.select("doc_id", "source"), {"src0": 0.5, "src1": 0.25, "src2": 1.0}, "source", "doc_id", 0.1)


def _eligible():
    return [templates.eligible(["quality"]) & (F.col("quality") == 1), templates.eligible(["toxic"]), templates.eligible(["text"])]


_CLAIMS = [f"(NOT {S.missing('quality')} AND quality = 1)", f"NOT {S.missing('toxic')}", f"NOT {S.missing('text')}"]
_WALK = " ".join(f"WHEN {ok} AND {S.uniform('doc_id', 42, repr(str(3 * f + k)))} < {share}::DOUBLE THEN {k}" for f, share in enumerate(sampling.FRACTIONS) for k, ok in enumerate(_CLAIMS))


@query(f"SELECT doc_id, CAST(CASE {_WALK} END AS INTEGER) AS template FROM documents LEFT JOIN labels USING (doc_id)")
def template_claim(t):
    return sampling.claim(t.labelled, _eligible(), "doc_id").select("doc_id", "template")


def _steps(claims: list[str], steps: list[tuple[int, str]], source: str) -> str:
    """Steps solved on patterns' counts: c{n} holds what is left of each pattern, t{n} what step n takes of it.

    steps: (template, SQL of how many of `total` are taken). Rows are numbered within their pattern.
    """
    bit = lambda k: f"(CASE WHEN {claims[k]} THEN {1 << k} ELSE 0 END)"
    out = [
        f"l AS MATERIALIZED (SELECT doc_id, {' + '.join(bit(k) for k in range(len(claims)))} AS pattern FROM {source})",
        f"r AS MATERIALIZED (SELECT doc_id, pattern, row_number() OVER (PARTITION BY pattern ORDER BY {S.draw('doc_id')}, doc_id) - 1 AS rn FROM l)",
        "c0 AS MATERIALIZED (SELECT pattern, count(*) AS have, 0::HUGEINT AS used FROM l GROUP BY pattern)",
    ]
    for n, (k, amount) in enumerate(steps):
        out += [
            f"m{n} AS (SELECT pattern, have, used, sum(have) OVER () AS total FROM c{n} WHERE pattern & {1 << k} > 0 AND have > 0)",
            f"a{n} AS (SELECT *, least(CAST({amount} AS BIGINT), total) AS n FROM m{n})",
            f"b{n} AS (SELECT pattern, n, n * have // total AS got, n - sum(n * have // total) OVER () AS rest, row_number() OVER (ORDER BY n * have % total DESC, hex(pattern)) AS place FROM a{n})",
            f"t{n} AS MATERIALIZED (SELECT pattern, got + CASE WHEN place <= rest THEN 1 ELSE 0 END AS got FROM b{n})",
            f"c{n + 1} AS MATERIALIZED (SELECT pattern, have - coalesce(got, 0) AS have, used + coalesce(got, 0) AS used FROM c{n} LEFT JOIN t{n} USING (pattern))",
        ]
    each = " UNION ALL ".join(f"SELECT r.doc_id, {k} AS template FROM r JOIN c{n} USING (pattern) JOIN t{n} USING (pattern) WHERE rn >= used AND rn < used + got" for n, (k, _) in enumerate(steps))
    return f"WITH {', '.join(out)} {each}"


_LABELLED = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


@query(_steps(_CLAIMS, [(k, f"floor({share}::DOUBLE * total)") for share in sampling.FRACTIONS for k in range(len(_CLAIMS))], _LABELLED))
def template_claim_exact(t):
    return sampling.claim_exact(t.labelled, _eligible(), "doc_id")


@query(f"""
WITH c AS (SELECT doc_id, CAST(CASE {_WALK} END AS INTEGER) AS template FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, template FROM c WHERE template IS NOT NULL ORDER BY template, {S.draw('doc_id')}, doc_id LIMIT 200
""")
def template_claim_capped(t):
    return sampling.capped(sampling.claim(t.labelled, _eligible(), "doc_id").select("doc_id", "template"), 200, "doc_id")


@query(_steps(_CLAIMS, [(2, "50"), (1, "40"), (0, "50")], _LABELLED))
def quota_assign(t):
    return sampling.quotas(t.labelled, _eligible(), 150, "doc_id", taken=[0, 10, 0])


@query(f"SELECT doc_id, list_filter(['en', 'fr', 'de', 'es'], lambda x: x <> lang)[{S.pick('3', 'doc_id')} + 1] AS other, {S.uniform('doc_id')} < 0.5 AS coin FROM documents")
def random_alternative(t):
    return t.documents.select("doc_id", sampling.other_than(["en", "fr", "de", "es"], "lang", "doc_id").alias("other"), (sampling.uniform("doc_id") < 0.5).alias("coin"))


_SEEDED = lambda arr, seed: f"list_transform(list_sort(list_transform({arr}, lambda v: {{'h': md5('{seed}:' || CAST(doc_id AS VARCHAR) || ':' || v), 'v': v}})), lambda x: x.v)"
_MCQ = f"""
WITH v AS (SELECT list(v ORDER BY {S.draw('v')}, v) AS pool FROM (SELECT DISTINCT source AS v FROM documents)),
p AS (SELECT doc_id, source, list_filter(list_transform(range(0, 5), lambda j: pool[({S.pick('len(pool)', 'doc_id')} + j) % len(pool) + 1]), lambda x: x <> source)[1:4] AS o FROM documents, v),
c AS (SELECT doc_id, source, {_SEEDED('list_append(o, source)', 43)} AS c FROM p)
"""


@query(_MCQ + "SELECT doc_id, md5(array_to_string(c, '|')) AS shown, ['أ', 'ب', 'ج', 'د', 'هـ'][list_position(c, source)] AS correct_choice FROM c")
def mcq_benchmark(t):
    out = sampling.choices(t.documents.select("doc_id", "source"), "source", "doc_id")
    return out.select("doc_id", F.md5(F.array_join(F.map_values("choices"), "|")).alias("shown"), "correct_choice")


@query(_MCQ + """SELECT doc_id, 'Which source?' || chr(10) || array_to_string(list_transform(range(1, len(c) + 1), lambda k: ['أ', 'ب', 'ج', 'د', 'هـ'][k] || '. ' || c[k]), chr(10)) AS question FROM c""")
def mcq_harness(t):
    out = sampling.choices(t.documents.select("doc_id", "source"), "source", "doc_id")
    return out.select("doc_id", templates.question(F.lit("Which source?"), F.col("choices")).alias("question"))


# --- templates, chat, exports ---------------------------------------------------------

TEMPLATES = [
    {"inputs": ["lang"], "output": "text", "variants": [("Write a text in {lang}.", "msa"), ("A text in {lang}, please.", "gulf")]},
    {"inputs": ["source"], "output": "text", "variants": [("Write like {source}.", "msa"), ("In the manner of {source}:", "levant"), ("{source}?", "gulf")]},
]
_T = [f"list_value({', '.join(repr(x) for x, _ in t['variants'])})[{S.pick(str(len(t['variants'])), 'doc_id', 42, repr(str(k)))} + 1]" for k, t in enumerate(TEMPLATES)]
_D = [f"list_value({', '.join(repr(d) for _, d in t['variants'])})[{S.pick(str(len(t['variants'])), 'doc_id', 42, repr(str(k)))} + 1]" for k, t in enumerate(TEMPLATES)]


@query(f"""
SELECT doc_id, template, CASE WHEN template = 0 THEN {_D[0]} ELSE {_D[1]} END AS dialect,
  CASE WHEN template = 0 THEN replace({_T[0]}, '{{lang}}', lang) ELSE replace({_T[1]}, '{{source}}', source) END AS input, md5({S.light("trim(text, ' ')")}) AS output
FROM (SELECT *, CAST(doc_id % 2 AS INTEGER) AS template FROM documents)
""")
def generation_samples(t):
    rows = t.documents.withColumn("template", (F.col("doc_id") % 2).cast("int"))
    return templates.samples(rows, TEMPLATES, "doc_id", "text", "generation").withColumn("output", F.md5("output"))


_PCT = f"(10 * ({S.pick('8', 'doc_id', 42, repr('cut'))} + 1))"


@query(f"""
WITH d AS (SELECT doc_id, {S.full_lines('text')} AS l, {_PCT} AS pct FROM documents),
c AS (SELECT doc_id, l, greatest(1, least(CAST(floor(len(l) * pct / 100) AS BIGINT), len(l) - 1)) AS k FROM d WHERE len(l) >= 2)
SELECT doc_id, k AS n_given, md5(array_to_string(l[1:k], chr(10))) AS given, md5(array_to_string(l[k + 1:], chr(10))) AS rest FROM c
""")
def continuation_samples(t):
    pct = F.get(F.array(*map(F.lit, templates.CUT_PERCENTS)), sampling.pick_index(8, "doc_id", 42, "cut"))
    c = lines.continuation("text", pct)
    rows = t.documents.select("doc_id", c.alias("c")).where("c is not null")
    return rows.select("doc_id", F.size(F.split("c.given", "\n")).cast("long").alias("n_given"), F.md5("c.given").alias("given"), F.md5("c.rest").alias("rest"))


@query(f"""
WITH k(template_no, corruption_type, template) AS (VALUES (0, 'full_style', 'Restore the style: {{corrupted_poem}}'), (1, 'rhyme_structure', 'Restore the rhyme: {{corrupted_poem}}'))
SELECT doc_id, corruption_type, md5({S.light("replace(template, '{corrupted_poem}', reverse(text))")}) AS input, md5({S.light('text')}) AS output
FROM documents JOIN labels USING (doc_id) JOIN k ON template_no = quality WHERE NOT {S.missing('reverse(text)')}
""")
def restoration_samples(t):
    kinds = rows_of(t.spark, "template_no int, corruption_type string, template string", (0, "full_style", "Restore the style: {corrupted_poem}"), (1, "rhyme_structure", "Restore the rhyme: {corrupted_poem}"))
    rows = t.labelled.withColumn("corrupted", F.reverse("text"))
    out = templates.restorations(rows, kinds, "doc_id", "corrupted", "text", "quality")
    return out.select("doc_id", "corruption_type", F.md5("input").alias("input"), F.md5("output").alias("output"))


@query("""
WITH d AS (SELECT CASE WHEN quality IS NULL THEN 'lang__source___text' ELSE 'quality___text' END AS key, lang FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'template' AS section, key, count(*) AS n FROM d GROUP BY key UNION ALL SELECT 'dialect', lang, count(*) FROM d GROUP BY lang
""")
def template_key_stats(t):
    inputs = F.when(F.col("quality").isNull(), F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))).otherwise(F.create_map(F.lit("quality"), F.col("quality").cast("string")))
    rows = t.labelled.select(inputs.alias("i"), F.create_map(F.lit("text"), F.lit("x")).alias("o"), "lang")
    return templates.usage(rows.withColumn("template_key", values.template_key("i", "o")), "template_key", "lang")


@query("""
SELECT conv_id, count(*) AS n, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS chatml,
  md5(string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' ORDER BY turn) || '<|assistant|>') AS tagged FROM conversations GROUP BY conv_id
""")
def chatml_render(t):
    rows = chat.messages(t.conversations, "conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(chat.chatml("messages")).alias("chatml"), F.md5(chat.tagged("messages", generate=True)).alias("tagged"))


@query("""
SELECT u.conv_id, u.turn, 'user' AS role, md5(u.text) AS prompt, md5(a.text) AS completion, md5('###Input:' || chr(10) || u.text || chr(10) || chr(10) || '###Output:' || chr(10)) AS instruction
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
""")
def prompt_completion(t):
    c = t.conversations
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    rows = chat.prompt_completion(u.join(a, ["conv_id", "turn"]), "q", "a")
    return rows.select("conv_id", "turn", F.col("prompt")[0]["role"].alias("role"), F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.md5(F.col("completion")[0]["content"]).alias("completion"), F.md5(chat.instruction("q")).alias("instruction"))


_IDS = lambda x: f"list_transform({S.words(x)}, lambda w: CAST('0x' || substring(md5(w), 1, 7) AS BIGINT))"


@query(f"""
WITH p AS (SELECT u.conv_id, u.turn, {_IDS('u.text')} AS p, {_IDS("u.text || ' ' || a.text")} AS f
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, CAST(least(len(f), 2048) AS BIGINT) AS n, CAST(least(len(p), len(f), 2048) AS BIGINT) AS masked, CAST(coalesce(list_sum(f[len(p) + 1:2048]), 0) AS BIGINT) AS label_sum FROM p
""")
def label_mask(t):
    c = t.conversations
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    rows = chat.tokenised(u.join(a, ["conv_id", "turn"]).withColumn("full", F.concat_ws(" ", "q", "a")), "q", "full")
    kept = F.filter("labels", lambda x: x != chat.IGNORED)
    return rows.select("conv_id", "turn", F.size("labels").cast("long").alias("n"), (F.size("labels") - F.size(kept)).cast("long").alias("masked"), F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x).alias("label_sum"))


@query(f"SELECT CASE WHEN len({S.words('text')}) >= 400 THEN 'LongContext' ELSE 'ShortContext' END AS context, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def context_router(t):
    rows = writers.routed(t.documents.withColumn("num_tokens", text.word_count("text")), threshold=400)
    return rows.groupBy("context", "lang").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, md5(CASE WHEN len({S.words('text')}) > 3484 THEN array_to_string({S.words('text')}[1:3484], ' ') ELSE text END) AS h FROM documents")
def token_budget(t):
    return t.documents.select("doc_id", F.md5(chat.budget("text", 4096, 512)).alias("h"))


@query(f"""
SELECT doc_id, task, CAST(list_position(['analysis', 'continuation', 'generation', 'corruption'], task) - 1 AS INTEGER) AS task_no, {S.draw('doc_id', 42, 'task')} AS mix_key
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'generation' WHEN 'fr' THEN 'analysis' ELSE 'corruption' END AS task FROM documents)
""")
def curriculum_mix(t):
    docs = t.documents.select("doc_id", "lang")
    tasks = {"generation": docs.where("lang = 'en'"), "analysis": docs.where("lang = 'fr'"), "corruption": docs.where("lang not in ('en', 'fr') or lang is null")}
    out = chat.mix(tasks, "doc_id", "curriculum")
    names = {n: templates.CURRICULUM.index(n) for n in tasks}
    return out.select("doc_id", "task", values.mapped("task", {n: str(k) for n, k in names.items()}).cast("int").alias("task_no"), "mix_key")


@query(" UNION ALL ".join(f"SELECT '{a}' AS in_col, '{b}' AS out_col, count(*) AS n_rows, CAST(sum(len({S.words(f'CAST({a} AS VARCHAR)')})) AS BIGINT) AS in_tokens, CAST(sum(len({S.words(f'CAST({b} AS VARCHAR)')})) AS BIGINT) AS out_tokens FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT {S.missing(a)} AND NOT {S.missing(b)}" for a, b in (("text", "lang"), ("text", "quality"), ("source", "toxic"))))
def io_pair_lengths(t):
    return templates.pair_lengths(t.labelled, [("text", "lang"), ("text", "quality"), ("source", "toxic")], text.word_count)


# --- metrics --------------------------------------------------------------------------

_M1 = f"""
w AS (SELECT doc_id, unnest({S.words(f"regexp_replace(text, '[^{LATIN}{S.WS[1:-1]}]', '', 'g')")}) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w),
m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_words, count(*) AS unique_words, count(*) FILTER (n > 1) AS repeated_words, max(n) AS max_word_frequency FROM c GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(total_words, 0) AS total_words, coalesce(unique_words, 0) AS unique_words, coalesce(repeated_words, 0) AS repeated_words, coalesce(max_word_frequency, 0) AS max_word_frequency,
  coalesce(repeated_words * 100.0::DOUBLE / unique_words, 0) AS word_repetition_rate, coalesce(unique_words / total_words, 0) AS unique_word_ratio, coalesce(total_words / unique_words, 0) AS avg_word_frequency
  FROM documents d LEFT JOIN m USING (doc_id))
"""


@query(f"WITH {_M1} SELECT * FROM r")
def repetition_metrics(t):
    return metrics.repetition(t.documents, "text", "doc_id", LATIN)


@query(f"""
WITH {_M1}, v AS (SELECT doc_id, lang, source, len({S.full_lines('text')}) AS v FROM documents)
SELECT lang, source, count(*) AS n, round(avg(word_repetition_rate), 6) AS rate, round(avg(unique_word_ratio), 6) AS variety, round(avg(avg_word_frequency), 6) AS frequency, round(avg(max_word_frequency), 6) AS top,
  round(avg(total_words), 6) AS words, round(avg(unique_words), 6) AS types, round(avg(v), 6) AS avg_lines, round(stddev_pop(v), 6) AS std_lines, min(v) AS min_lines, max(v) AS max_lines
FROM r JOIN v USING (doc_id) GROUP BY lang, source
""")
def generation_metrics(t):
    out = metrics.generation_metrics(t.documents, "text", "doc_id", "lang", "source", letters=LATIN)
    names = {"word_repetition_rate": "rate", "unique_word_ratio": "variety", "avg_word_frequency": "frequency", "max_word_frequency": "top", "total_words": "words", "unique_words": "types"}
    out = out.withColumnsRenamed({f"mean_{a}": b for a, b in names.items()})
    return out.withColumns({c: F.round(c, 6) for c in (*names.values(), "avg_lines", "std_lines")} | {c: F.col(c).cast("long") for c in ("min_lines", "max_lines")})


@query(f"""
WITH {_M1}, s AS (SELECT lang, source, CAST(sum(repeated_words) AS BIGINT) * 100.0::DOUBLE / CAST(sum(unique_words) AS BIGINT) AS rate, CAST(sum(unique_words) AS BIGINT) / CAST(sum(total_words) AS BIGINT) AS uwr, CAST(sum(total_words) AS BIGINT) / CAST(sum(unique_words) AS BIGINT) AS freq
  FROM r JOIN documents USING (doc_id) GROUP BY lang, source),
k AS (SELECT lang, source, 0.5::DOUBLE * rate / 100 + 0.3::DOUBLE * (1 - uwr) + 0.2::DOUBLE * (freq - 1) / 10 AS score FROM s)
SELECT lang, source, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, source) AS rn FROM k) WHERE rn = 1
""")
def best_config(t):
    rows = metrics.repetition(t.documents, "text", "doc_id", LATIN).join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    runs = rows.groupBy("lang", "source").agg(F.sum("total_words").alias("n"), F.sum("unique_words").alias("u"), F.sum("repeated_words").alias("r"))
    runs = runs.withColumn("score", metrics.composite(F.col("r") * 100.0 / F.col("u"), F.col("u") / F.col("n"), F.col("n") / F.col("u")))
    return metrics.best(runs, "lang", "source", "score")


@query(f"SELECT source, count(*) AS n, min(v) AS min_lines, max(v) AS max_lines, CAST(sum(v) AS BIGINT) / count(*) AS avg_lines, round(stddev_pop(v), 6) AS std_lines FROM (SELECT source, len({S.full_lines('text')}) AS v FROM documents) GROUP BY source")
def run_line_metrics(t):
    out = metrics.run_metrics(t.documents, "text", "source")
    return out.select("source", "n", F.col("min_lines").cast("long").alias("min_lines"), F.col("max_lines").cast("long").alias("max_lines"), "avg_lines", F.round("std_lines", 6).alias("std_lines"))


_P = S.collapse("(CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN text ELSE left(text, 50) END)")


@query(f"""
WITH d AS (SELECT lang, {_P} AS p, {S.collapse('text')} AS r FROM documents)
SELECT lang, count(*) AS n, CAST(sum(length(p)) AS BIGINT) / count(*) AS avg_pred_len, CAST(sum(length(r)) AS BIGINT) / count(*) AS avg_ref_len, count(*) FILTER (p = '') / count(*) AS empty_rate, count(*) FILTER (p = r) / count(*) AS exact_match FROM d GROUP BY lang
""")
def prediction_metrics(t):
    made = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.left("text", F.lit(50)))
    return metrics.prediction_metrics(t.documents.withColumn("made", made), "made", "text", "lang")


@query("""
WITH d AS (SELECT event_type AS kind, value > 50 AS ok FROM events)
SELECT kind, count(*) AS n, count(*) FILTER (ok) AS succeeded, count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS pct FROM (SELECT * FROM d UNION ALL SELECT 'ALL', ok FROM d) GROUP BY kind
""")
def success_by_type(t):
    return metrics.success(t.events.withColumnRenamed("event_type", "kind"), "kind", F.coalesce(F.col("value") > 50, F.lit(False)))


@query(f"""
WITH d AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 3 THEN '{{"corrupted_poem": "x"' || CASE WHEN doc_id % 8 = 3 THEN ', "corrupted_era": "e"}}' ELSE '}}' END ELSE replace(text, 'e', 'e ') END AS changed,
  CASE doc_id % 4 WHEN 0 THEN 'rhyme_content' WHEN 1 THEN 'meter_destruction' ELSE 'era' END AS kind FROM documents)
SELECT doc_id, kind, length(text) AS original_length, length(changed) AS changed_length, CAST(length(changed) - length(text) AS BIGINT) AS length_change, regexp_matches(changed, '[{LATIN}]') AS has_script,
  CASE WHEN kind = 'rhyme_content' THEN len({S.lines('text')}) = len({S.lines('changed')}) END AS line_count_preserved, CASE WHEN kind = 'era' THEN doc_id % 4 = 3 END AS json_valid, CASE WHEN kind = 'era' THEN doc_id % 8 = 3 END AS has_changed_era,
  CASE WHEN kind = 'meter_destruction' THEN CAST(len({S.words('changed')}) - len({S.words('text')}) AS BIGINT) END AS word_count_change FROM d WHERE text IS NOT NULL
""")
def change_report(t):
    kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'rhyme_content' WHEN 1 THEN 'meter_destruction' ELSE 'era' END")
    made = F.expr("""CASE WHEN doc_id % 8 = 3 THEN '{"corrupted_poem": "x", "corrupted_era": "e"}' WHEN doc_id % 4 = 3 THEN '{"corrupted_poem": "x"}' ELSE replace(text, 'e', 'e ') END""")
    rows = t.documents.where("text is not null").withColumns({"changed": made, "kind": kind})
    out = metrics.change_report(rows, "text", "changed", "kind", LATIN)
    return out.select("doc_id", "kind", *(F.col(c).cast("long").alias(c) for c in ("original_length", "changed_length", "length_change")), "has_script", "line_count_preserved", "json_valid", "has_changed_era", F.col("word_count_change").cast("long").alias("word_count_change"))


@query("SELECT event_type, count(*) FILTER (event_id % 5 <> 0) AS n, avg(event_id % 6) FILTER (event_id % 5 <> 0) AS fluency, avg(event_id % 4) FILTER (event_id % 5 <> 0) AS coherence FROM events GROUP BY event_type")
def judge_scores(t):
    reply = F.expr("""CASE WHEN event_id % 5 = 0 THEN 'no json' ELSE concat('{"fluency": {"score": ', event_id % 6, ', "reason": "r"}, "coherence": {"score": ', event_id % 4, ', "reason": "r"}}') END""")
    return metrics.judged(t.events.select("event_type", reply.alias("reply")), "reply", "event_type", aspects=["fluency", "coherence"])


# --- evaluation -----------------------------------------------------------------------

_SCORES = """
s AS (SELECT doc_id AS sample_id, 'm' || CAST(doc_id % 4 AS VARCHAR) AS model, 'a' || CAST(k AS VARCHAR) AS annotator,
  CAST((CAST('0x' || substring(md5('a' || k || ':' || doc_id), 1, 2) AS BIGINT) % 5 + 1) AS DOUBLE) AS c1, CAST((CAST('0x' || substring(md5('b' || k || ':' || doc_id), 1, 2) AS BIGINT) % 5 + 1) AS DOUBLE) AS c2
  FROM documents, range(0, 3) r(k) WHERE k < 2 OR doc_id % 5 = 0)
"""


def _scores(t):
    """Scores that stand for annotators' sheets: two for each document, a third for one in five."""
    rows = t.documents.select(F.col("doc_id").alias("sample_id"), F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("model"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).where("k < 2 or sample_id % 5 = 0")
    point = lambda p: (F.conv(F.substring(F.md5(F.concat(F.lit(p), F.col("k").cast("string"), F.lit(":"), F.col("sample_id").cast("string"))), 1, 2), 16, 10).cast("long") % 5 + 1).cast("double")
    return rows.select("sample_id", "model", F.concat(F.lit("a"), F.col("k").cast("string")).alias("annotator"), point("a").alias("c1"), point("b").alias("c2"))


@query(f"WITH {_SCORES} SELECT model, avg(c1) AS c1_mean, round(stddev_samp(c1), 6) AS c1_std, count(c1) AS c1_n, avg(c2) AS c2_mean, round(stddev_samp(c2), 6) AS c2_std, count(c2) AS c2_n, avg((c1 + c2) / 2) AS overall_mean, round(stddev_samp((c1 + c2) / 2), 6) AS overall_std, count(*) AS overall_n FROM s GROUP BY model")
def human_eval_scores(t):
    out = evaluation.model_scores(_scores(t), "model", ["c1", "c2"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_std")})


@query(f"WITH {_SCORES}, m AS (SELECT model, avg((c1 + c2) / 2) AS overall_mean FROM s GROUP BY model) SELECT model, overall_mean, CAST(row_number() OVER (ORDER BY overall_mean DESC, model) AS INTEGER) AS rank FROM m")
def human_eval_rankings(t):
    means = evaluation.model_scores(_scores(t), "model", ["c1", "c2"]).select("model", "overall_mean")
    return evaluation.ranked(means, "model", "overall_mean")


@query(f"""
WITH {_SCORES}, m AS (SELECT model, avg(c1) AS c1, avg(c2) AS c2 FROM s GROUP BY model), l AS (SELECT 'c1' AS criterion, model, c1 AS score FROM m UNION ALL SELECT 'c2', model, c2 FROM m)
SELECT criterion, model, score FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY score DESC, model) AS rn FROM l) WHERE rn = 1
""")
def best_per_criterion(t):
    return evaluation.best_per_criterion(_scores(t), "model", ["c1", "c2"])


@query(f"WITH {_SCORES}, n AS (SELECT sample_id, model, count(DISTINCT annotator) AS n FROM s GROUP BY 1, 2) SELECT count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS three_or_more FROM n")
def annotator_coverage(t):
    return evaluation.coverage(_scores(t), ["sample_id", "model"], "annotator")


@query(f"""
WITH {_SCORES}, p AS (SELECT a.annotator AS a, b.annotator AS b, corr(a.c1, b.c1) AS r1, corr(a.c2, b.c2) AS r2 FROM s a JOIN s b USING (sample_id, model) WHERE a.annotator < b.annotator GROUP BY 1, 2)
SELECT 'c1' AS criterion, round(avg(r1), 9) AS correlation, count(r1) AS pairs FROM p UNION ALL SELECT 'c2', round(avg(r2), 9), count(r2) FROM p
""")
def annotator_agreement(t):
    return evaluation.agreement(_scores(t), ["sample_id", "model"], "annotator", ["c1", "c2"]).withColumn("correlation", F.round("correlation", 9))


@query(f"""
WITH {_SCORES}, g AS (SELECT model, count(*) AS n, sum(c1) AS s, sum(c1 * c1) AS q FROM s GROUP BY model), o AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g)
SELECT groups, n, round((b - s * s / n) / (groups - 1) / ((q - b) / (n - groups)), 9) AS f FROM o
""")
def anova_f(t):
    return evaluation.variance_ratio(_scores(t), "model", "c1").withColumn("f", F.round("f", 9))


_THREE = _SCORES.replace("doc_id % 4", "doc_id % 3")


@query(f"""
WITH {_THREE}, l AS (SELECT model, 'c1' AS criterion, c1 AS c FROM s UNION ALL SELECT model, 'c2', c2 FROM s),
g AS (SELECT criterion, model, count(*) AS n, sum(c) AS s, sum(c * c) AS q FROM l GROUP BY criterion, model),
o AS (SELECT criterion, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g GROUP BY criterion),
f AS (SELECT criterion, groups, n, (b - s * s / n) / (groups - 1) / ((q - b) / (n - groups)) AS f FROM o)
SELECT criterion, groups, n, round(f, 9) AS f, round(pow(1 + 2 * f / (n - groups), -(n - groups) / 2.0::DOUBLE), 9) AS p, pow(1 + 2 * f / (n - groups), -(n - groups) / 2.0::DOUBLE) < 0.05 AS significant FROM f
""")
def score_tests_of_three(t):
    """With three groups the tail of F is a power."""
    rows = _scores(t).withColumn("model", F.concat(F.lit("m"), (F.col("sample_id") % 3).cast("string")))
    return evaluation.tests(rows, "model", ["c1", "c2"]).withColumns({"f": F.round("f", 9), "p": F.round("p", 9)})


@query()
def score_tests(t):
    return evaluation.tests(_scores(t), "model", ["c1", "c2"])


@query(f"""
WITH r AS (SELECT doc_id, lang AS item, source AS model FROM documents WHERE source IS NOT NULL),
c AS (SELECT item FROM r GROUP BY item HAVING count(DISTINCT model) = (SELECT count(DISTINCT source) FROM documents) ORDER BY {S.draw('item')}, item LIMIT 2),
i AS (SELECT item, printf('sample_%03d', row_number() OVER (ORDER BY {S.draw('item')}, item)) AS sample_id FROM c),
b AS (SELECT model, 'model_' || CAST(row_number() OVER (ORDER BY {S.draw('model')}) AS VARCHAR) AS model_id FROM (SELECT DISTINCT model FROM r))
SELECT sample_id, model_id, doc_id, {S.draw("sample_id || '/' || model_id")} AS sheet_key FROM (SELECT *, row_number() OVER (PARTITION BY item, model ORDER BY doc_id) AS rn FROM r) JOIN i USING (item) JOIN b USING (model) WHERE rn = 1
""")
def blind_sheet(t):
    rows = t.documents.select("doc_id", F.col("lang").alias("item"), F.col("source").alias("model"))
    models = sorted(r[0] for r in rows.where("model is not null").select("model").distinct().collect())  # the models under test are few
    return evaluation.blind_sheet(rows, "item", "model", models, 2, "doc_id").select("sample_id", "model_id", "doc_id", "sheet_key")


_TASKS = ["de", "en", "es", "fr"]


@query(f"""
WITH a AS (SELECT source AS model, lang AS task, count(*) % 5 / 4.0::DOUBLE AS v FROM documents GROUP BY 1, 2)
SELECT model, coalesce(CAST(avg(v) FILTER (task IN {tuple(_TASKS)}) AS VARCHAR), '') AS "Overall", {', '.join(f"coalesce(CAST(max(v) FILTER (task = '{x}') AS VARCHAR), '') AS {x}" for x in _TASKS)} FROM a GROUP BY model
""")
def accuracy_matrix(t):
    """Counts stand for accuracies, a results file per model and task."""
    rows = t.documents.groupBy(F.col("source").alias("model"), "lang").agg((F.count("*") % 5 / 4.0).alias("v"))
    rows = rows.where(F.col("lang").isNotNull()).select("model", F.concat(F.lit('{"results": {"'), "lang", F.lit('": {"acc,none": '), F.col("v").cast("string"), F.lit("}}}")).alias("body"))
    return evaluation.accuracy_matrix(evaluation.harness_results(rows, "body"), "model", "task", "accuracy", _TASKS)


# --- pages, paths, events -------------------------------------------------------------


@query(f"SELECT page_id, nullif({S.collapse(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')}, '') AS title FROM pages")
def page_title(t):
    return t.pages.select("page_id", html.title("html").alias("title"))


@query("""SELECT page_id, nullif(regexp_extract(html, '(?is)<html[^>]*\\slang=["'']?([A-Za-z-]+)', 1), '') AS lang FROM pages""")
def page_lang(t):
    return t.pages.select("page_id", html.language("html").alias("lang"))


@query("""SELECT page_id, len(l) AS n, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']', 1) AS l FROM pages)""")
def page_links(t):
    own = html.links("html")
    return t.pages.select("page_id", F.size(own).cast("long").alias("n"), F.array_join(own, " ").alias("links"))


@query(f"""SELECT page_id, md5({S.collapse("regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")}) AS h FROM pages""")
def page_text(t):
    return t.pages.select("page_id", F.md5(html.visible_text("html")).alias("h"))


@query()
def page_records(t):
    out = html.extract(t.pages, "html", ("page_id", "url"))
    return out.select("page_id", "title", "poem_url", F.size("tags").alias("n_tags"), F.md5("text").alias("text"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)/*$', 1) AS last FROM pages")
def url_parts(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/]*)/*$", 1).alias("last"))


@query("SELECT lang, arg_max(lang || '/' || source || '/checkpoint-' || doc_id, doc_id) AS path FROM documents WHERE doc_id % 3 <> 0 GROUP BY lang")
def latest_checkpoint(t):
    path = F.expr("concat(lang, '/', source, CASE WHEN doc_id % 3 = 0 THEN '/other-' ELSE '/checkpoint-' END, doc_id)")
    return readers.latest(t.documents.select("lang", path.alias("path")), "lang")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    return streams.windowed(t.events, "ts", "value", "event_type").withColumn("total", F.round("total", 4))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s
""")
def event_sessions(t):
    return streams.sessions(t.events, "ts", "user_id").select("user_id", "start", "n")


# --- relations ------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS n_orders, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_back(t):
    new = t.labels.select("doc_id", "quality").unionByName(enrich.pending(t.documents, t.labels, "doc_id").select("doc_id", F.lit(-1).alias("quality")))
    base = t.documents.select("doc_id", "lang")
    langs = base.where("doc_id % 2 = 0").select("doc_id", F.lit("even").alias("lang"))
    return enrich.merge_back(enrich.merge_back(base, new, "doc_id", ["quality"]), langs, "doc_id", ["lang"])


@query("SELECT doc_id, k AS corruption_type FROM documents, (VALUES ('full_style'), ('rhyme_structure')) v(k)")
def cross_types(t):
    return templates.expanded(t.documents.select("doc_id"), ["full_style", "rhyme_structure"])


@query("SELECT a.lang, a.n AS n_a, b.n AS n_b FROM (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY lang) b USING (lang)")
def outer_alignment(t):
    side = lambda k: t.documents.where(f"doc_id % 2 = {k}").groupBy("lang").agg(F.count("*").alias(f"n_{'ab'[k]}"))
    return side(0).join(side(1), "lang", "full_outer")


@query("SELECT doc_id AS id, CAST(NULL AS VARCHAR) AS url, text FROM documents UNION ALL SELECT page_id, url, NULL FROM pages")
def union_aligned(t):
    a = t.documents.select(F.col("doc_id").alias("id"), "text")
    return a.unionByName(t.pages.select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query(f"SELECT DISTINCT {S.hard('text')} AS t FROM documents WHERE lang = 'fr' EXCEPT SELECT {S.hard('text')} FROM documents WHERE {HELD}")
def set_difference(t):
    c = text.clean_hard("text").alias("t")
    return t.documents.where("lang = 'fr'").select(c).distinct().subtract(t.documents.where(HELD).select(c))


@query("""
SELECT doc_id, CASE WHEN source = 'src1' THEN 'one' WHEN source = 'src2' THEN 'two' END AS mapped, CASE WHEN contains(source, '1') THEN source END AS era, CASE WHEN NOT contains(source, '1') THEN source END AS location
FROM documents WHERE source NOT IN ('src7', 'src8')
""")
def routed_columns(t):
    has = F.col("source").contains("1")
    rows = t.documents.where(F.col("source").isNull() | ~F.col("source").isin("src7", "src8"))
    return rows.select("doc_id", values.mapped("source", {"src1": "one", "src2": "two"}).alias("mapped"), F.when(has, F.col("source")).alias("era"), F.when(~has, F.col("source")).alias("location"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NULL OR quality <> 1) AND n_chars BETWEEN 500 AND 5000")
def null_keeping_filters(t):
    return t.labelled.where(~F.col("quality").eqNullSafe(1) & F.col("n_chars").between(500, 5000)).select("doc_id")


@query(f"SELECT doc_id, {S.missing('quality')} AS missing, (lang IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS filled FROM documents LEFT JOIN labels USING (doc_id)")
def missing_flags(t):
    return t.labelled.select("doc_id", missing.is_missing("quality").alias("missing"), missing.filled("lang", "quality", "toxic").alias("filled"))


from . import files, flows, shapes  # noqa: E402, F401  these register more queries
