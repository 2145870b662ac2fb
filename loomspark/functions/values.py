"""Values that come as text: lists, maps, JSON replies, tags, names of eras and meters."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, col, trim_ws


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_list(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Python list literals that are not JSON, such as those with apostrophes within values."""

    def parse(text):
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [str(x) for x in value if x] if isinstance(value, list) else None

    for part in parts:
        yield part.map(parse)


def list_items(c, literals: bool = False) -> Column:
    """The items of a list written as JSON (single quotes too); null if it is none.

    literals: also parse, in Python, what only a Python literal explains.
    """
    text = trim_ws(F.replace(col(c), F.lit('""'), F.lit('"')))
    found = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    if literals:
        # only texts that JSON can't explain cross to Python
        hard = F.when(text.startswith("[") & found.isNull(), text)
        found = F.coalesce(found, F.when(hard.isNotNull(), _literal_list(hard)))
    return F.filter(F.transform(found, trim_ws), lambda x: x.isNotNull() & (x != ""))


def naturalize(c, literals: bool = False) -> Column:
    """A written list as a phrase: commas, and the conjunction before the last; other text stays."""
    own = list_items(c, literals)
    n = F.size(own)
    # The Arabic comma, and with the conjunction.
    many = F.concat(F.array_join(F.slice(own, F.lit(1), F.greatest(n - 1, F.lit(1))), "، "), F.lit("، و"), F.get(own, n - 1))
    return F.when(own.isNull(), col(c)).when(n == 0, "").when(n == 1, F.get(own, F.lit(0))).otherwise(many)


def parse_field(c) -> Column:
    """A template field as a map: a JSON map, a list (each item its own value), or a bare string; missing is {default: unknown}."""
    text = trim_ws(F.regexp_replace(trim_ws(col(c)), '^"|"$', ""))
    text = F.replace(text, F.lit('""'), F.lit('"'))
    as_map = F.when(text.startswith("{"), F.from_json(text, "map<string,string>"))
    items = list_items(text)
    as_list = F.map_from_arrays(F.array_distinct(items), F.array_distinct(items))
    bare = F.when(text != "", F.create_map(text, text))
    return F.coalesce(as_map, as_list, bare, F.create_map(F.lit("default"), F.lit("unknown")))


def template_key(inputs, outputs) -> Column:
    """Sorted input keys, three underscores, sorted output keys; keys joined by two."""
    join = lambda m: F.array_join(F.array_sort(F.map_keys(col(m))), "__")
    return F.concat(join(inputs), F.lit("___"), join(outputs))


def first_integer(c) -> Column:
    return F.regexp_extract(col(c).cast("string"), "([0-9]+)", 1).try_cast("long")


def quoted(c) -> Column:
    """All quoted parts, single or double."""
    return F.transform(F.regexp_extract_all(col(c), F.lit("""("[^"]*"|'[^']*')"""), 1), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def three_tags(c) -> Column:
    """(meter, genre, era) out of exactly three quoted values, else null."""
    own = quoted(c)
    return F.when(F.size(own) == 3, F.struct(own[0].alias("meter"), own[1].alias("genre"), own[2].alias("era")))


def comma_parts(c, n: int) -> Column:
    """n trimmed parts between commas, or null."""
    own = F.transform(F.split(col(c), ","), trim_ws)
    return F.when(F.size(own) == n, own)


# Words that tell what a tag names, in order of priority.
TAG_RULES = {"genre": ["قصائد"], "poem_type": ["عموديه", "التفعيله", "نثريه"], "rhyme": ["قافية"], "meter": ["بحر"]}


def tag_classes(c) -> dict[str, Column]:
    """Each class's last tag; a tag belongs to the first class whose word it has."""
    own = F.transform(col(c), trim_ws)

    def last(marks: list[str], earlier: list[str]) -> Column:
        has = lambda t, words: reduce(lambda a, b: a | b, [t.contains(w) for w in words], F.lit(False))
        return F.try_element_at(F.filter(own, lambda t: has(t, marks) & ~has(t, earlier)), F.lit(-1))

    out, earlier = {}, []
    for name, marks in TAG_RULES.items():
        out[name] = last(marks, list(earlier))
        earlier += marks
    return out


def mapped(c, table: dict[str, str]) -> Column:
    """The table's value, null on a miss."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), col(c))


# Synonyms of eras; values that stand for no era or meter; countries found among eras.
ERAS = {
    "الحديث": "العصر الحديث",
    "العثماني": "العصر العثماني",
    "المملوكي": "العصر المملوكي",
    "العباسي": "العصر العباسي",
    "الأموي": "العصر الأموي",
    "الفاطمي": "العصر الفاطمي",
    "الأيوبي": "العصر الأيوبي",
    "قبل الإسلام": "العصر الجاهلي",
    "العصر الايوبي": "العصر الأيوبي",
    "العصر الاموي": "العصر الأموي",
    "الدولة الايوبية": "العصر الأيوبي",
    "الدولة الفاطمية": "العصر الفاطمي",
    "الدولة المملوكية": "العصر المملوكي",
    "بين الدولتين": "عصر بين الدولتين",
    "الإسلامي": "العصر الإسلامي",
    "العصر الاسلامي": "العصر الإسلامي",
    "المخضرمون": "المخضرمون",
    "المخضرمين": "المخضرمون",
    "الشعراء المخضرمون": "المخضرمون",
}
NO_ERA = ["عصرين", "غير محدد"]
NO_METER = ["بحر nan", "بحر None", "بحر"]
COUNTRIES = ["مصر", "لبنان", "المغرب", "سوريا", "تونس", "فلسطين", "موريتانيا", "العراق", "اليمن", "ليبيا", "السعودية", "السودان", "الجزائر", "الأردن", "عمان", "الإمارات"]


def normal_meter(c) -> Column:
    """With the word for meter in front, without article; null where it names none."""
    c = trim_ws(c)
    named = F.when(c.startswith("البحر"), F.concat(F.lit("بحر "), F.regexp_replace(c, f"^البحر{WS}+", ""))).when(c.startswith("بحر"), c).otherwise(F.concat(F.lit("بحر "), c))
    return F.when((c != "") & ~named.isin(*NO_METER), named)


def normal_era(c, table: dict[str, str] = ERAS, none: list[str] = NO_ERA) -> Column:
    """The era's usual name; unknown names stay; values for no era become null."""
    named = F.coalesce(mapped(c, table), col(c))
    return F.when(~named.isin(*none), named)


def fenced(c) -> Column:
    """The JSON text of a reply: in a json fence, any fence, triple quotes, or from the first brace to the last; null if none."""
    pick = lambda p: F.nullif(F.regexp_extract(col(c), p, 1), F.lit(""))
    return trim_ws(F.coalesce(pick(r"(?s)```json\s*(.*?)\s*```"), pick(r"(?s)```\s*(.*?)\s*```"), pick(r'(?s)"""\s*(.*?)\s*"""'), pick(r"(?s)(\{.*\})")))


def reply_items(c, fields: str = "id string, corrupted_poem string") -> Column:
    """The objects of a batch reply: a JSON array, else every flat object in the text, else one with the raw text under the second field."""
    text = F.coalesce(fenced(c), col(c))
    whole = F.regexp_extract(col(c), r"(?s)(\[.*\])", 1)
    as_array = F.when(whole != "", F.from_json(whole, f"array<struct<{fields.replace(' string', ': string')}>>"))
    good = F.filter(as_array, lambda x: x.isNotNull() & x["id"].isNotNull())
    flat = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1), lambda t: F.from_json(t, fields)), lambda x: x["id"].isNotNull())
    first, second = (f.split()[0] for f in fields.split(", ")[:2])
    raw = F.array(F.struct(F.lit(None).cast("string").alias(first), col(c).alias(second)))
    return F.when(F.size(good) > 0, good).when(F.size(flat) > 0, flat).otherwise(raw)


def row_number_id(c) -> Column:
    """(prompt, row) of an id such as p3_r17; null for others."""
    c = col(c)
    ok = c.rlike("^p[0-9]+_r[0-9]+$")
    return F.when(ok, F.struct(*(F.regexp_extract(c, "^p([0-9]+)_r([0-9]+)$", k).try_cast("long").alias(n) for k, n in ((1, "prompt"), (2, "row")))))
