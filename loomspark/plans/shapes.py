"""Queries that give the unifiers, cleaning functions and template helpers inputs made of documents' columns."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lines, missing, text, values
from ..operators import enrich, sampling, templates
from ..sources import html, unify
from . import sql as S
from .catalog import query


def made(t, *columns: str, of: str = "documents"):
    return getattr(t, of).selectExpr(*columns)


# --- unifiers ---


@query("""
SELECT lang AS poem_title, source AS poet_name, md5(string_agg('a' || doc_id || chr(9) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'b' END, chr(10) ORDER BY doc_id)) AS poem_text,
  CASE WHEN min(doc_id) % 2 = 0 THEN 'العصر العباسي' END AS poet_era, arg_min('g' || doc_id, doc_id) AS genre FROM documents GROUP BY lang, source
""")
def unified_grouped_lines(t):
    rows = made(t, "lang AS poem_title", "source AS poet", "doc_id AS pos", "concat('a', doc_id) AS first_hemistich", "CASE WHEN doc_id % 3 <> 0 THEN 'b' END AS second_hemistich", "CASE WHEN doc_id % 2 = 0 THEN 'Abbasid' ELSE 'none' END AS era", "concat('g', doc_id) AS type_ar")
    return unify.grouped_lines(rows).withColumn("poem_text", F.md5("poem_text")).select("poem_title", "poet_name", "poem_text", "poet_era", "genre")


@query("SELECT doc_id, source || chr(9) || lang AS poem_text, source AS poet_name, lang AS poet_era, 'r' AS rhyme, 'm' || doc_id AS meter FROM documents")
def unified_hemistich_columns(t):
    rows = made(t, "doc_id", "source AS `الشطر الايمن`", "lang AS `الشطر الايسر`", "source AS `الشاعر`", "lang AS `العصر`", "'r' AS `القافية`", "concat('m', doc_id) AS `البحر`", "1 AS `البيت`", "2 AS `الديوان`")
    return unify.hemistich_columns(rows)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'العصر ' || lang END AS poet_era, CASE WHEN doc_id % 2 = 1 THEN source END AS location, 'u' || doc_id AS source, 'p' AS poet_url FROM documents")
def unified_category_split(t):
    return unify.category_split(made(t, "doc_id", "CASE WHEN doc_id % 2 = 0 THEN concat('العصر ', lang) ELSE source END AS poet_cat", "concat('u', doc_id) AS poem_link", "'p' AS poet_link", "1 AS poem_style", "2 AS poet_id"))


@query("SELECT doc_id, lang || chr(9) || source || chr(10) || 'x' || chr(9) || 'y z' AS poem_text, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE 'plain ' || lang END AS overall_explanation, source AS poet_name FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, NULL, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE 'plain ' || lang END, source FROM documents WHERE doc_id % 5 = 0")
def unified_quoted_poems(t):
    """Every fifth poem has a line of nine parts, which makes it unreadable."""
    verses = """concat('"', lang, '" "', source, '"\n no quotes here \n', CASE WHEN doc_id % 5 = 0 THEN repeat('"q" ', 9) ELSE '"x" "y" "z"' END) AS `poem verses`"""
    told = """CASE WHEN doc_id % 2 = 0 THEN concat('[{"text": "', lang, '"}, {"text": "', source, '"}') ELSE concat('plain ', lang) END AS `poem description`"""
    return unify.quoted_poems(made(t, "doc_id", verses, told, "source AS `poet name`", "1 AS `poet location`"))


@query("SELECT doc_id AS poem_id, 'one ' || lang || chr(9) || 'two' || chr(10) || 'three ' || source AS poem_text, doc_id % 3 <> 0 AS valid, CASE WHEN doc_id % 3 <> 0 THEN lang END AS meter, CASE WHEN doc_id % 3 <> 0 THEN source END AS genre, CASE WHEN doc_id % 3 <> 0 THEN 'e' END AS poet_era, 't' AS poem_title FROM documents")
def unified_numbered_poems(t):
    rows = made(t, "doc_id AS id", "concat('1\n one ', lang, '\n two\n2\n\nthree ', source) AS poem_verses", """CASE WHEN doc_id % 3 = 0 THEN "'a' 'b'" ELSE concat('["', lang, '", \\'', source, '\\', "e"]') END AS tags""", "'t' AS title")
    return unify.numbered_poems(rows).select("poem_id", "poem_text", "valid", "meter", "genre", "poet_era", "poem_title")


@query("SELECT doc_id, 'a' || chr(9) || 'b' || chr(10) || lang || chr(9) || source AS poem_text, CAST(2 AS BIGINT) AS poem_verses, lang AS genre, 'type' AS poem_type, source AS meter, 'r' AS rhyme FROM documents WHERE doc_id % 4 <> 1")
def unified_counted_poems(t):
    """Every fourth poem declares another number of verses than it has."""
    rows = made(t, "doc_id", "concat('a\nb\n', lang, '\n', source, '\nodd') AS poem_text", "concat(CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 2 END, ' verses') AS poem_count", "concat(lang, ', type ,', source, ',r') AS poem_tags")
    return unify.counted_poems(rows).drop("tags")


@query("SELECT doc_id, 'p' || doc_id AS poem_text, 3 AS poem_verses, lang AS poet_era, CASE doc_id % 4 WHEN 0 THEN 'حزن' WHEN 1 THEN 'فرح' WHEN 2 THEN 'رومانسية' END AS genre FROM documents")
def unified_emotional_poems(t):
    return unify.emotional_poems(made(t, "doc_id", "concat('p', doc_id) AS poem", "3 AS verses", "lang AS era", "element_at(array('sad', 'joy', 'love', 'other'), int(doc_id % 4) + 1) AS emotion"))


@query("SELECT doc_id, lang AS poem_title, CASE WHEN doc_id % 3 = 0 THEN 'عصر ' || lang WHEN doc_id % 3 = 1 THEN 'المخضرمون' END AS poet_era, CASE WHEN doc_id % 3 = 2 THEN source END AS location, CASE WHEN doc_id % 2 = 0 THEN 'x' || chr(10) || 'y' ELSE 'a' || chr(10) || 'x' || chr(10) || 'y' END AS poem_text FROM documents")
def unified_filed_poems(t):
    rows = made(t, "doc_id", "lang AS poem_name", "CASE doc_id % 3 WHEN 0 THEN concat('عصر ', lang) WHEN 1 THEN 'المخضرمون' ELSE source END AS era", "concat(CASE WHEN doc_id % 2 = 0 THEN 'صدر' ELSE 'a' END, '\nx\ny') AS poem")
    return unify.filed_poems(rows)


@query("""
SELECT doc_id AS poem_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || ' - x' END AS poem_title,
  CASE doc_id % 3 WHEN 0 THEN 'a' || chr(9) || 'b' WHEN 1 THEN 'a' || chr(10) || 'b' ELSE 'a' || chr(9) || 'b' || chr(10) || 'c' || chr(9) || source END AS poem_text,
  CASE WHEN doc_id % 4 = 2 THEN 'مصر' END AS location, CASE WHEN doc_id % 4 IN (0, 3) THEN 'العصر ' || lang END AS poet_era, 'قصائد ' || lang AS genre, 'بحر ' || source AS meter, 'قافية x' AS rhyme FROM documents WHERE doc_id % 4 <> 1
""")
def unified_scraped_poems(t):
    rows = made(
        t, "doc_id AS id", "concat(lang, ' - x') AS title", "element_at(array('diwan', 'adab', 'poets_gate'), int(doc_id % 3) + 1) AS source",
        "CASE doc_id % 3 WHEN 0 THEN 'a\tb' WHEN 1 THEN 'a\n\n\n\tb' ELSE concat('a\nb\nc\n', source) END AS poem",
        "CASE doc_id % 4 WHEN 1 THEN 'ذكاء اصطناعي' WHEN 2 THEN 'مصر' ELSE concat('العصر ', lang) END AS era", "array(concat('قصائد ', lang), concat(' بحر ', source), 'قافية x', 'other') AS tags",
    )
    return unify.scraped_poems(rows).select("poem_id", "poem_title", "poem_text", "location", "poet_era", "genre", "meter", "rhyme")


@query("SELECT doc_id, lang AS poet_name, source AS poet_era, 'a' || chr(9) || 'b' || chr(9) || 'c' AS poem_text, 't' AS poem_title FROM documents")
def unified_adab_world(t):
    return unify.adab_world(made(t, "doc_id", "concat(' ', lang, ' ') AS poet_name", "concat(source, '\t') AS poet_era", "'a\t\tb\tc' AS verses_formatted", "'t' AS title", "1 AS page", "2 AS theme"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'عموديه' WHEN 1 THEN 'بحر ' || lang ELSE 'بحر ' || source END AS meter, CASE WHEN doc_id % 3 = 0 THEN 'عموديه' END AS poem_type, 'a' || chr(9) || 'b' AS poem_text, 'x' AS poet_name FROM documents")
def unified_arapoet(t):
    return unify.arapoet(made(t, "doc_id", "CASE doc_id % 3 WHEN 0 THEN 'عموديه' WHEN 1 THEN concat('بحر ', lang) ELSE source END AS meter", "'a\t\tb' AS hemistichs_format", "'x' AS author", "1 AS verse_count"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'بحر مجزوء الرجز' ELSE source END AS meter, CASE WHEN doc_id % 2 = 1 THEN lang END AS genre, 'a' || chr(9) || 'b' AS poem_text FROM documents")
def unified_mawsooaa(t):
    return unify.mawsooaa(made(t, "doc_id", "source AS meter", "CASE WHEN doc_id % 2 = 0 THEN 'مجزوء الرجز' ELSE lang END AS theme", "'a\t\tb' AS hemistichs_format"))


@query("""
WITH u AS (
  SELECT 'mine' AS dataset_name, 'p' || doc_id AS poem_text, lang AS poem_title, NULL AS genre FROM documents
  UNION ALL SELECT 'Arabic-Poetry-Melody', 'q' || doc_id || chr(10) || 'r', NULL, 'حزن' FROM documents)
SELECT row_number() OVER (ORDER BY dataset_name, md5(poem_text)) AS poem_id, dataset_name, poem_text, poem_title, genre, CAST(CASE WHEN dataset_name = 'mine' THEN 1 ELSE 2 END AS BIGINT) AS poem_verses FROM u
""")
def unified_union(t):
    mine = made(t, "concat('p', doc_id) AS poem", "lang AS poem_name", "'عصر' AS era")
    melody = made(t, "concat('q', doc_id, '\nr') AS poem", "'sad' AS emotion", "CAST(NULL AS STRING) AS verses")
    out, unknown = unify.unify_all({"mine": mine, "Arabic-Poetry-Melody": melody, "unknown": mine}, {"mine": "filed_poems"})
    if unknown != ["unknown"]:
        raise ValueError(unknown)
    return out.select("poem_id", "dataset_name", "poem_text", "poem_title", "genre", "poem_verses")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'مصر' WHEN 1 THEN source END AS location, CASE doc_id % 3 WHEN 1 THEN 'العصر الحديث' WHEN 2 THEN lang END AS poet_era, 'بحر ' || lang AS meter FROM documents")
def normalised_eras(t):
    """An era that names a country moves to an empty location."""
    rows = made(t, "doc_id", "CASE doc_id % 3 WHEN 0 THEN 'مصر' WHEN 1 THEN 'الحديث' ELSE lang END AS poet_era", "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source END AS location", "lang AS meter")
    return unify.normalise_eras(rows)


@query("SELECT doc_id, lang AS original, n_chars % 3 = 0 AND doc_id % 2 = 0 AS valid, CASE WHEN n_chars % 3 = 0 AND doc_id % 2 = 0 THEN source END AS meter FROM documents")
def split_valid_rows(t):
    """Rows whose tags are no three, or whose declared verses are not the text's, are told from good ones."""
    rows = made(t, "doc_id AS id", "'1\na' AS poem_verses", """CASE WHEN n_chars % 3 = 0 THEN concat('"', source, '" "b" "c"') ELSE '"a"' END AS tags""", "CASE WHEN doc_id % 2 = 0 THEN '1 verse' ELSE '2 verses' END AS verse_count", "lang")
    out = unify.numbered_poems(rows, strict=True)
    return out.select(F.col("poem_id").alias("doc_id"), F.col("lang").alias("original"), "valid", F.when(F.col("valid"), F.coalesce("meter", "genre", "poet_era")).alias("meter"))


@query("SELECT c AS name FROM (VALUES ('doc_id'), ('lang'), ('quality')) v(c)")
def valued_columns(t):
    """Columns of labelled documents with a value among those of quality 1; absent ones are added as nulls."""
    rows = missing.with_columns(t.labelled.select("doc_id", "lang", "quality"), "era", "lang").withColumn("g", F.when(F.col("quality") == 1, "a").otherwise("b"))
    names = unify.valued_columns(rows, "g", "a")
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))


# --- functions ---


@query(f"""
SELECT doc_id, md5(array_to_string({S.lines('text')}[1:3], chr(10))) AS three, md5(array_to_string({S.lines('text')}[2:3], chr(10))) AS inner_two, md5(array_to_string({S.lines('text')}[2:], chr(10))) AS rest,
  md5('a' || chr(9) || lang || '|' || source) AS verses FROM documents
""")
def line_functions(t):
    numbered = F.expr("concat('12\n a\n', lang, '\n 3 \n', source, '\n44')")
    return t.documents.select("doc_id", F.md5(lines.first_lines("text", 3)).alias("three"), F.md5(lines.window("text", F.lit(1), F.lit(2))).alias("inner_two"), F.md5(lines.drop_first_line("text")).alias("rest"), F.md5(F.array_join(lines.numbered_verses(numbered), "|")).alias("verses"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a=' || lang WHEN 1 THEN lang || '=' || lang || ',' || source || '=' || source WHEN 2 THEN lang || '=' || lang ELSE 'default=unknown' END AS field,
  lang || '|' || source || '''s' AS quoted_parts, 'p1_r' || doc_id || ':x' || chr(10) || 'p2_r1:y' AS replies FROM documents
""")
def value_functions(t):
    d = F.col("doc_id") % 4
    field = F.when(d == 0, F.expr("""concat('{"a": "', lang, '"}')""")).when(d == 1, F.expr("""concat('["', lang, '", "', source, '"]')""")).when(d == 2, F.col("lang")).otherwise(F.lit(" "))
    shown = F.array_join(F.transform(F.map_entries(values.parse_field(field)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    parts = F.array_join(values.quoted(F.expr("""concat("x '", lang, "' y ", '"', source, "'s", '" z')""")), "|")
    good = F.expr("""concat('[{"id": "p1_r', doc_id, '", "corrupted_poem": "x"}, {"id": "p2_r1", "corrupted_poem": "y"}]')""")
    loose = F.expr("""concat('well {"id": "p1_r', doc_id, '", "corrupted_poem": "x"} and {"id": "p2_r1", "corrupted_poem": "y"} so')""")
    replies = F.array_join(F.transform(values.reply_items(F.when(F.col("doc_id") % 2 == 0, good).otherwise(loose)), lambda x: F.concat(x["id"], F.lit(":"), x["corrupted_poem"])), "\n")
    return t.documents.select("doc_id", shown.alias("field"), parts.alias("quoted_parts"), replies.alias("replies"))


@query("SELECT doc_id, 'قصائد ' || lang AS genre, CASE WHEN doc_id % 2 = 0 THEN 'بحر ' || source END AS meter, CASE WHEN doc_id % 3 = 0 THEN 'قافية ب' ELSE 'قافية أ' END AS rhyme, 'نثريه' AS poem_type FROM documents")
def tag_classes(t):
    """A tag belongs to the first class whose word it has, and the last tag of a class counts."""
    tags = F.array_compact(F.array(F.lit("قافية أ"), F.concat(F.lit(" قصائد "), "lang"), F.lit("نثريه"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("بحر "), "source")), F.when(F.col("doc_id") % 3 == 0, "قافية ب")))
    return t.documents.withColumns(values.tag_classes(tags)).select("doc_id", "genre", "meter", "rhyme", "poem_type")


@query(f"SELECT doc_id, md5({S.trim('text')}) AS stripped, 'x ' || lang AS bullet, '\"' || lang || '\"' AS title, CASE WHEN doc_id % 2 = 0 THEN '' END AS empty_title, lang || chr(10) || source AS both, CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) || '' END AS some FROM documents")
def small_text_functions(t):
    rows = missing.strip_strings(t.documents).withColumns({"bullet": F.concat(F.lit("-• x "), "lang", F.lit(" -")), "e": F.when(F.col("doc_id") % 2 == 0, "")})
    return rows.select("doc_id", F.md5("text").alias("stripped"), text.strip_bullets("bullet").alias("bullet"), templates.quoted_title("lang").alias("title"), templates.quoted_title("e").alias("empty_title"), templates.joined_or_null("lang", "source").alias("both"), templates.joined_or_null("lang", "e").alias("some"))


@query(f"SELECT doc_id, quality IS NOT NULL AND NOT {S.missing('text')} AS ready, {S.light('text')} = {S.light('replace(text, chr(32), chr(32) || chr(32))')} AS unchanged FROM documents LEFT JOIN labels USING (doc_id)")
def readiness(t):
    """Rows with values in all columns; texts that are the same once cleaned."""
    rows = t.labelled.withColumn("wide", F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
    return rows.select("doc_id", templates.eligible(["quality", "text"]).alias("ready"), templates.unchanged(rows, "text", "wide").alias("unchanged"))


@query("SELECT doc_id, 'Name ' || lang AS name, 'line ' || source || chr(10) || 'last' AS description FROM documents")
def profiles(t):
    p = html.profile(F.expr("concat('\n  Name ', lang, ' \n\n line ', source, '\n  last\n')"))
    return t.documents.select("doc_id", p.alias("p")).select("doc_id", "p.name", "p.description")


# --- templates, assignment, alignment ---


@query("""
WITH r AS (SELECT CASE WHEN doc_id % 3 < 2 THEN 'lang,source' ELSE 'lang' END AS inputs, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'title' END AS output, lang, source, doc_id FROM documents),
v AS (SELECT inputs, output, 'A ' || lang AS text, 'msa' AS dialect FROM r UNION SELECT inputs, output, 'B ' || source, 'gulf' FROM r WHERE doc_id % 5 <> 0)
SELECT inputs, output, string_agg(text || ':' || dialect, '|' ORDER BY text, dialect) AS variants, CAST(row_number() OVER (ORDER BY len(string_split(inputs, ',')) DESC, inputs, output) AS INTEGER) AS place
FROM v GROUP BY inputs, output
""")
def grouped_templates(t):
    """A sheet with a line for each document; place is where a template comes by its number of inputs."""
    sheet = made(t, "CASE doc_id % 3 WHEN 0 THEN 'lang, source' WHEN 1 THEN 'lang,source' ELSE 'lang' END AS placeholder", "CASE WHEN doc_id % 2 = 0 THEN 'text ' ELSE 'title' END AS output", "concat('A ', lang) AS msa", "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE concat('B ', source) END AS gulf")
    # numbers in the order in which the rows come
    out = templates.by_arity(templates.grouped(sheet)).withColumn("_n", F.monotonically_increasing_id())
    shown = F.array_join(F.transform("variants", lambda v: F.concat(v["text"], F.lit(":"), v["dialect"])), "|")
    return out.select(F.array_join("inputs", ",").alias("inputs"), "output", shown.alias("variants"), F.row_number().over(Window.orderBy("_n")).alias("place"))


@query("SELECT doc_id, 'Go on:' || chr(10) || chr(10) || lang || chr(10) || ' in ' || source AS prompt FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 1")
def filled_prompts(t):
    """A tidied template for one kind; other kinds have none."""
    rows = t.documents.withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "go").otherwise("stay"))
    tidy = rows.withColumn("template", templates.tidy_template(F.lit("-Go on:\n{poem_text} in {poet_name}")))
    fields = {"poem_text": F.col("lang"), "poet_name": F.col("source")}
    return tidy.select("doc_id", F.when(F.col("kind") == "go", templates.filled_in("template", fields)).alias("prompt"))


@query("WITH q AS (SELECT CAST(k AS INTEGER) AS template FROM range(0, 6) r(k)) SELECT template, CAST(greatest(0, 600 // 6 - (SELECT count(*) FROM labels WHERE quality = template)) AS BIGINT) AS left_over FROM q")
def remaining_quotas(t):
    rows = t.labels.select(F.col("quality").cast("int").alias("template"))
    return sampling.remaining(rows, "template", 600, 6).withColumnRenamed("left", "left_over")


@query("""
WITH b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)
SELECT row AS output_no, doc_id, lang, row % 5 AS prompt_num FROM b WHERE row % 3 <> 1
""")
def outputs_by_row_number(t):
    """Ids such as p3_r17 name the base's row; ids of another form are dropped."""
    base = t.documents.select("doc_id", "lang")
    numbers = sampling.row_numbers(base, "doc_id").select((F.col("pos") - 1).alias("output_no"))
    ids = F.when(F.col("output_no") % 3 == 1, F.lit("bad")).otherwise(F.concat(F.lit("p"), (F.col("output_no") % 5).cast("string"), F.lit("_r"), F.col("output_no").cast("string")))
    return enrich.rows_by_id(numbers.withColumn("id", ids), base, "id", "doc_id").select("output_no", "doc_id", "lang", "prompt_num")


@query("SELECT doc_id, n - 1 - row AS other, CASE WHEN CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) AS INTEGER) % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, count(*) OVER () AS n FROM documents)")
def zipped_tables(t):
    """Two equally long tables by place, the second in descending order."""
    a = t.documents.select("doc_id")
    b = sampling.row_numbers(a, "doc_id").select((F.col("pos") - 1).alias("other"), (-F.col("pos")).alias("o"))
    return enrich.zipped(a, b, "doc_id", "o", "doc_id").select("doc_id", "other", "side")


@query("SELECT lang || source AS stem, 'ar_' || lang || source AS left_name, 'en_' || lang || source AS right_name FROM (SELECT DISTINCT lang, source FROM documents) WHERE lang <> 'en'")
def matched_file_names(t):
    pairs = t.documents.select("lang", "source").distinct()
    a = pairs.where("lang <> 'en'").select(F.concat(F.lit("ar_"), "lang", "source").alias("name"))
    return enrich.matched_names(a, pairs.select(F.concat(F.lit("en_"), "lang", "source").alias("name")), "name")


_SIZE = f"least({S.pick('5', 'doc_id', 42, repr('size'))} + 1, len(l))"
_START = f"CAST(floor((len(l) - {_SIZE} + 1) * {S.uniform('doc_id', 42, repr('start'))}) AS INTEGER)"


@query(f"SELECT doc_id, md5(array_to_string(l[{_START} + 1 : {_START} + {_SIZE}], chr(10))) AS lines_md5 FROM (SELECT doc_id, {S.lines('text')} AS l FROM documents)")
def random_windows(t):
    """one to five neighbouring lines, by the row's draw."""
    return t.documents.select("doc_id", F.md5(templates.random_window("text", "doc_id")).alias("lines_md5"))




@query("""
SELECT doc_id, 'T ' || doc_id AS title, 'http://x/' || doc_id AS poem_url, 'x/cat-poet-' || doc_id AS poet_page_url, source AS poet, 'era ' || lang AS era, source AS country, 'about ' || lang AS poet_description, 'id' || doc_id || '@' AS poet_english_id,
  CASE doc_id % 3 WHEN 0 THEN lang || chr(9) || source || chr(10) || 'odd' || chr(9) WHEN 1 THEN lang || chr(10) || source ELSE 'in ' || lang || chr(10) || 'area' END AS poem, 't ' || lang || '|u' AS tags FROM documents
""")
def built_page_records(t):
    """H1 to H7 on pages of three layouts, whose fields are documents' columns."""
    page = """concat('<html><head><title>', lang, ' - ', source, ' - site</title>', CASE WHEN doc_id % 2 = 0 THEN concat('<link rel="canonical" href="http://x/', doc_id, '">') ELSE concat('<meta property="og:url" content="http://x/', doc_id, '">') END,
        CASE WHEN doc_id % 3 = 0 THEN concat('<script type="application/ld+json">{"itemListElement": [{"name": "era ', lang, '", "item": "e"}, {"name": "p", "item": {"@id": "x/cat-poet-', doc_id, '"}}, {"name": "T ', doc_id, '", "item": "t"}]}</script>') ELSE '' END, '</head><body>',
        CASE WHEN doc_id % 3 <> 0 THEN concat('<div class="a breadcrumb"><a href="e"> era ', lang, '</a><a href="x/cat-poet-', doc_id, '">p</a><a href="t">T  ', doc_id, '</a></div>') ELSE '' END,
        CASE doc_id % 3 WHEN 0 THEN concat('<h3>', lang, '</h3><h3> ', source, '</h3><h3>odd</h3>') WHEN 1 THEN concat('<h4>', lang, '<br>', source, '</h4>') ELSE concat('<textarea id="post_content">in  ', lang, '\n area</textarea><h3>no</h3>') END,
        '<div class="tips"><a>t ', lang, '</a><a> u </a></div><span class="country">‏', source, '</span><div class="poet-description"><p>about  ', lang, '</p></div><span> id', doc_id, '@ </span></body></html>')"""
    out = html.checked(html.extract(made(t, "doc_id", f"{page} AS html"), "html", ("doc_id",)))
    return out.select("doc_id", "title", "poem_url", "poet_page_url", "poet", "era", "country", "poet_description", "poet_english_id", "poem", F.array_join("tags", "|").alias("tags"))
