"""Instruction data: templates grouped, claimed, filled; questions, continuations, restorations, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines
from ..functions.missing import is_missing
from ..functions.text import clean_light, col
from ..functions.values import naturalize
from .sampling import LETTERS, SEED, pick_index, uniform

# Dialect columns of a template sheet; tasks in curriculum order; pairs of input and output columns;
# kinds of corruption by template number.
DIALECTS = ["msa", "nile valley", "north africa", "gulf", "levant"]
CURRICULUM = ["analysis", "continuation", "generation", "corruption"]
IO_PAIRS = [
    ("poem_text", "poet_name"),
    ("poem_text", "poem_title"),
    ("poem_text", "meter"),
    ("poem_text", "poet_era"),
    ("poem_text", "genre"),
    ("poem_text", "location"),
    ("poem_text", "overall_explanation"),
    ("poem_text", "verses_explanation"),
    ("poet_name", "poet_description"),
    ("poet_name", "location"),
    ("poet_name", "poet_era"),
]
CORRUPTION_KINDS = ["full_style", "rhyme_structure", "rhyme_content", "rhyme_substitution", "era_corruption", "meter_transformation", "meter_destruction", "meter_inconsistency"]
CUT_PERCENTS = list(range(10, 90, 10))


def corruption_kind(template) -> Column:
    """The kind that a template's number, from 0, stands for; null for other numbers."""
    return F.get(F.array(*map(F.lit, CORRUPTION_KINDS)), col(template))


def grouped(sheet: DataFrame, dialects: list[str] = DIALECTS) -> DataFrame:
    """(inputs, output, variants): a row per placeholders and output, all filled dialect texts as variants (text, dialect)."""
    have = [d for d in dialects if d in sheet.columns]
    texts = F.filter(F.array(*(F.struct(F.col(f"`{d}`").alias("text"), F.lit(d).alias("dialect")) for d in have)), lambda v: v["text"].isNotNull() & (F.trim(v["text"]) != ""))
    inputs = F.filter(F.transform(F.split(F.coalesce("placeholder", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = sheet.select(inputs.alias("inputs"), F.trim("output").alias("output"), F.explode(texts).alias("v"))
    return rows.groupBy("inputs", "output").agg(F.array_sort(F.collect_set("v")).alias("variants"))


def by_arity(templates: DataFrame) -> DataFrame:
    """Templates with most inputs first."""
    return templates.orderBy(F.size("inputs").desc(), F.array_join("inputs", ","), "output")


def tidy_template(c) -> Column:
    """Dashes go; poem placeholders stand on lines of their own."""
    out = F.replace(col(c), F.lit("-"), F.lit(""))
    for name in ("{existing_verses}", "{poem_text}"):
        out = F.replace(out, F.lit(name), F.lit(f"\n{name}\n"))
    return out


def filled_in(template, fields: dict[str, Column]) -> Column:
    """The template with its placeholders filled; null if one stays open or a value for one is null."""
    text = col(template)
    for name, value in fields.items():
        hole = F.lit("{" + name + "}")
        text = F.when(F.contains(text, hole), F.replace(text, hole, value)).otherwise(text)
    return F.when(~text.rlike(r"\{[A-Za-z_]+\}"), text)


def quoted_title(c) -> Column:
    return F.when(col(c).isNotNull() & (col(c) != ""), F.concat(F.lit('"'), col(c), F.lit('"'))).otherwise(col(c))


def eligible(columns: list[str]) -> Column:
    """All columns have values."""
    return reduce(lambda a, b: a & b, [~is_missing(c) for c in columns], F.lit(True))


def samples(df: DataFrame, templates: list[dict], key: str, text: str, task: str, max_lines: int = 0, seed: int = SEED) -> DataFrame:
    """(key, template, dialect, input, output): rows claimed by a template, filled in.

    templates: dicts of inputs, output and variants, each a (text, dialect); they are few
    and part of the plan. Rows whose template stays open are left out; so are texts of
    fewer than two lines in the continuation task.
    """
    branches_text, branches_dialect, branches_out = F.lit(None), F.lit(None), F.lit(None)
    body = lines.first_lines(text, max_lines) if max_lines > 0 else F.col(text)
    percent = F.get(F.array(*map(F.lit, CUT_PERCENTS)), pick_index(len(CUT_PERCENTS), key, seed, "cut"))
    cut = lines.continuation(text, percent)
    for t, spec in reversed(list(enumerate(templates))):
        own = F.get(F.array(*(F.struct(F.lit(x).alias("text"), F.lit(d).alias("dialect")) for x, d in spec["variants"])), pick_index(len(spec["variants"]), key, seed, t))
        fields = {n: F.col(n).cast("string") for n in spec["inputs"] if n in df.columns}
        fields = {n: naturalize(c) for n, c in fields.items()}
        if "poem_title" in fields:
            fields["poem_title"] = quoted_title(fields["poem_title"])
        fields |= {"poem_text": body, "existing_verses": cut["given"]}
        # what no variant has a place for is never made
        fields = {n: c for n, c in fields.items() if any("{" + n + "}" in x for x, _ in spec["variants"])}
        here = F.col("template") == t
        branches_text = F.when(here, filled_in(tidy_template(own["text"]), fields)).otherwise(branches_text)
        branches_dialect = F.when(here, own["dialect"]).otherwise(branches_dialect)
        out = cut["rest"] if task == "continuation" else F.trim(F.col(spec["output"]).cast("string"))
        branches_out = F.when(here, out).otherwise(branches_out)
    made = F.struct(F.col("template"), branches_dialect.alias("dialect"), clean_light(branches_text).alias("input"), clean_light(branches_out).alias("output"))
    # a generator's rows are made once; a filter on what was made would make it a second time
    whole = F.filter(F.array(made), lambda x: x["input"].isNotNull() & x["output"].isNotNull())
    return df.where("template is not null").select(F.col(key), F.inline(whole))


def restorations(df: DataFrame, templates: DataFrame, key: str, corrupted: str, original: str, assigned: str) -> DataFrame:
    """(key, corruption_type, input, output): the assigned template around the corrupted text; rows without either are left out.

    templates (template_no, corruption_type, template): as many rows as there are kinds.
    """
    rows = df.where(~is_missing(corrupted) & F.col(assigned).isNotNull())
    joined = rows.join(F.broadcast(templates), rows[assigned].cast("int") == templates["template_no"])
    text = filled_in("template", {"corrupted_poem": F.col(corrupted), "poem_text": F.col(corrupted)})
    return joined.select(key, "corruption_type", clean_light(text).alias("input"), clean_light(original).alias("output")).where("input is not null")


def unchanged(df: DataFrame, a: str, b: str) -> Column:
    """Whether two texts are the same once cleaned; null differs from everything."""
    return F.coalesce(clean_light(a) == clean_light(b), F.lit(False))


def question(text, choices: Column, letters: list[str] = LETTERS) -> Column:
    """The question and a 'letter. choice' line for each choice there is, in the letters' order."""
    names = F.filter(F.array(*map(F.lit, letters)), lambda x: F.map_contains_key(choices, x))
    return F.concat_ws("\n", col(text), F.array_join(F.transform(names, lambda x: F.concat(x, F.lit(". "), F.element_at(choices, x))), "\n"))


def options(choices: Column, letters: list[str] = LETTERS) -> Column:
    return F.filter(F.array(*map(F.lit, letters)), lambda x: F.map_contains_key(choices, x))


def joined_or_null(*columns: str) -> Column:
    """The columns with newlines between; null if any is."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(ok, F.concat_ws("\n", *columns))


def pair_lengths(df: DataFrame, pairs: list[tuple[str, str]], count) -> DataFrame:
    """(in_col, out_col, rows, in_tokens, out_tokens) of each pair of columns where both have values; one pass over df.

    count: expression of a text's tokens.
    """
    parts = F.array(*(F.struct(F.lit(f"{a}__{b}").alias("pair"), F.lit(a).alias("in_col"), F.lit(b).alias("out_col"), (~is_missing(a) & ~is_missing(b)).alias("ok"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs))
    rows = df.select(F.explode(parts).alias("p")).where("p.ok")
    return rows.groupBy("p.in_col", "p.out_col").agg(F.count("*").alias("n_rows"), F.sum(count(F.col("p.x"))).cast("long").alias("in_tokens"), F.sum(count(F.col("p.y"))).cast("long").alias("out_tokens"))


def usage(df: DataFrame, key: str = "template_key", dialect: str = "dialect") -> DataFrame:
    """(section, key, n): how often templates and dialects are used."""
    both = F.array(F.struct(F.lit("template").alias("section"), F.col(key).alias("key")), F.struct(F.lit("dialect").alias("section"), F.col(dialect).alias("key")))
    return df.select(F.explode(both).alias("x")).groupBy("x.section", "x.key").agg(F.count("*").alias("n"))


def stats_lines(spark, path: str) -> DataFrame:
    """(section, key, n) of a written statistics file, whose sections are titled."""
    text = spark.read.text(path, wholetext=True)
    parts = F.regexp_extract_all("value", F.lit(r"(?m)^((?:Template|Dialect) Statistics|[^\n]+: *[0-9]+)\s*$"), 1)
    tagged = text.select(F.posexplode(parts).alias("i", "line"), parts.alias("all"))
    head = F.try_element_at(F.filter(F.slice("all", F.lit(1), F.col("i") + 1), lambda x: x.endswith(" Statistics")), F.lit(-1))
    rows = tagged.select(F.regexp_replace(head, " Statistics$", "").alias("section"), "line").where(~F.col("line").endswith(" Statistics"))
    return rows.select("section", F.regexp_extract("line", r"^(.*): *[0-9]+$", 1).alias("key"), F.regexp_extract("line", r": *([0-9]+)$", 1).cast("long").alias("n"))


def prompts(df: DataFrame, kind: str, by_kind: dict[str, str], fields: dict[str, Column]) -> DataFrame:
    """df with prompt: the text for its kind, filled in; null for unknown kinds or open fields."""
    out = F.lit(None).cast("string")
    for name, text in by_kind.items():
        out = F.when(F.col(kind) == name, filled_in(F.lit(text), fields)).otherwise(out)
    return df.withColumn("prompt", out)


# Prompts for outside models, by what they ask for; the texts are this library's own.
KEYWORDS = 'Read the Arabic poem below. Answer in Arabic with JSON only, {"keywords": [three words], "key_phrases": [three phrases]}: what the poem is about, and its most telling expressions.\n\n{poem_text}'
_KEEP = " Return the changed poem only, one verse a line, as many lines as there were."
CORRUPTIONS = {
    "rhyme_structure": "Rewrite the poem so that no two verses rhyme any more; it rhymes in {rhyme} now. Keep meaning and meter." + _KEEP + "\n\n{poem_text}",
    "rhyme_content": "Rewrite the poem by {poet_name} ({poet_era}) so that its content makes no sense, while every verse still rhymes in {rhyme}." + _KEEP + "\n\n{poem_text}",
    "rhyme_substitution": "Give the poem, which rhymes in {rhyme}, another rhyme throughout. Keep meaning and meter." + _KEEP + "\n\n{poem_text}",
    "era": 'Rewrite the poem {poem_title} by {poet_name} from the style of {poet_era} into that of {target_era}. Answer with JSON only: {"corrupted_poem": text, "corrupted_era": era}.\n\n{poem_text}',
    "meter_destruction": "Rewrite the poem by {poet_name} ({poet_era}), now in {meter}, so that it has no meter. Keep meaning and rhyme." + _KEEP + "\n\n{poem_text}",
    "meter_transformation": "Rewrite the poem by {poet_name} ({poet_era}) from {meter} into {target_meter}. Keep meaning and rhyme." + _KEEP + "\n\n{poem_text}",
    "meter_inconsistency": "Rewrite the poem by {poet_name} ({poet_era}), now in {meter}, so that every verse has another rhythm. Keep meaning and rhyme." + _KEEP + "\n\n{poem_text}",
}


def expanded(df: DataFrame, kinds: list[str], column: str = "corruption_type") -> DataFrame:
    """Every row with every kind."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, kinds))))


def random_window(text: str, key: str, most: int = 5, seed: int = SEED) -> Column:
    """One to five neighbouring lines of a text, by the row's draw."""
    n = F.size(F.split(F.col(text), "\n"))
    size = F.least(pick_index(most, key, seed, "size") + 1, n)
    return lines.window(text, F.floor((n - size + 1) * uniform(key, seed, "start")).cast("int"), size)

