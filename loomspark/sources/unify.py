"""Twelve sources into one schema: each unifier is a projection; the union aligns columns by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines, missing, values
from ..functions.text import before_dash, strip_marks, trim_ws

# Names of eras by their English keys; emotions; countries, junk eras and meters as scraped pages have them.
ERA_NAMES = {
    "Pre_Islam": "قبل الإسلام",
    "Seasoned": "المخضرمون",
    "Abbasid": "العصر العباسي",
    "Umayyad": "العصر الأموي",
    "Andalusian": "العصر الأندلسي",
    "Mamluk": "العصر المملوكي",
    "Islamic": "العصر الإسلامي",
    "Ayyubid": "العصر الأيوبي",
    "Fatimid": "العصر الفاطمي",
    "Ottoman": "العصر العثماني",
    "Modern": "العصر الحديث",
    "Dual_eras": "عصرين",
    "Unspecified": "غير محدد",
}
EMOTIONS = {"sad": "حزن", "joy": "فرح", "love": "رومانسية"}
SCRAPED_COUNTRIES = ["الإمارات", "السعودية", "البحرين", "قطر", "الكويت", "عمان", "اليمن", "مصر", "الأردن", "فلسطين", "العراق", "سوريا", "لبنان", "تونس", "الجزائر", "المغرب", "ليبيا", "السودان", "موريتانيا", "السنغال", "الصومال"]
JUNK_ERAS = ["Unknown", ">", "أشعار موضوعية", "الشعراء الأعضاء .. عامِّي", "ذكاء اصطناعي"]
THEME_METERS = ["مجزوء الرجز", "مجزوء الوافر", "أحذ الكامل", "منهوك المنسرح", "مشطور الرجز", "مجزوء الكامل المرفّل", "منهوك الرجز"]
COLUMN_METER = "عموديه"


def grouped_lines(df: DataFrame, order: str = "pos") -> DataFrame:
    """Rows of hemistich pairs. order: the column with the rows' order, which files alone don't keep.

    Lines are put together by title and poet; rows without either are left out.
    """
    line = F.concat(F.coalesce("first_hemistich", F.lit("")), F.lit("\t"), F.coalesce("second_hemistich", F.lit("")))
    rows = df.withColumn("_line", line).where("poem_title is not null and poet is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_line"))), lambda x: x["_line"]), "\n")
    others = [c for c in ("era", "type_ar", "link") if c in df.columns]
    head = F.min_by(F.struct(*others), order) if others else None
    out = rows.groupBy("poem_title", "poet").agg(text.alias("poem_text"), *([head.alias("_h")] if others else []))
    out = out.select("poem_title", F.col("poet").alias("poet_name"), "poem_text", *(F.col(f"_h.{c}").alias(c) for c in others))
    if "era" in others:
        out = out.withColumn("era", values.mapped("era", ERA_NAMES))
    return out.withColumnsRenamed({"era": "poet_era", "type_ar": "genre", "link": "source"})


def hemistich_columns(df: DataFrame) -> DataFrame:
    """Right and left half in columns of their own."""
    return df.withColumn("poem_text", F.concat_ws("\t", F.col("الشطر الايمن").cast("string"), F.col("الشطر الايسر").cast("string"))).withColumnsRenamed({"الشاعر": "poet_name", "العصر": "poet_era", "القافية": "rhyme", "البحر": "meter"}).drop("الديوان", "الشطر الايمن", "الشطر الايسر", "البيت")


def category_split(df: DataFrame) -> DataFrame:
    """A category that names an age is an era, any other a location."""
    age = F.col("poet_cat").contains("العصر")
    return df.withColumn("poet_era", F.when(age, F.col("poet_cat"))).withColumn("location", F.when(~age, F.col("poet_cat"))).drop("poem_style", "poet_cat", "poet_id").withColumnsRenamed({"poem_link": "source", "poet_link": "poet_url"})


def quoted_verses(c: str):
    """U4: quoted parts of each line, halved by a tab; null if a line has more than eight; lines without any are left out."""
    parts = F.filter(F.transform(F.split(F.col(c), "\n"), values.quoted), lambda p: F.size(p) > 0)
    half = lambda p: F.floor(F.size(p) / 2).cast("int")
    left = lambda p: F.array_join(F.slice(p, F.lit(1), half(p)), " ")
    right = lambda p: F.array_join(F.slice(p, half(p) + 1, F.size(p)), " ")
    joined = F.transform(parts, lambda p: F.concat(left(p), F.lit("\t"), right(p)))
    return F.when(~F.exists(parts, lambda p: F.size(p) > 8), F.array_join(joined, "\n"))


def described(c: str):
    """The texts of a written list of {text: ...}; a missing end bracket is added; other text stays."""
    text = trim_ws(c)
    mended = F.when(text.startswith("[") & ~text.endswith("]"), F.concat(text, F.lit("]"))).otherwise(text)
    found = F.from_json(mended, "array<struct<text: string>>")
    return F.when(found.isNotNull(), F.concat_ws(" ", F.transform(found, lambda x: x["text"]))).otherwise(F.col(c))


def quoted_poems(df: DataFrame) -> DataFrame:
    """U6, with U4 and U5."""
    df = df.withColumn("poem verses", quoted_verses("poem verses"))
    if "poem description" in df.columns:
        df = df.withColumn("poem description", described("poem description"))
    names = {"poem title": "poem_title", "poem meter": "meter", "poem verses": "poem_text", "poem theme": "genre", "poem url": "poem_url", "poet name": "poet_name", "poet description": "poet_description", "poet url": "poet_url", "poet era": "poet_era", "poem description": "overall_explanation"}
    return df.drop("poet location", "poem language type").withColumnsRenamed(names)


def numbered_poems(df: DataFrame, strict: bool = False) -> DataFrame:
    """Verses between numbers, tags of three. Rows whose tags are other stay with nulls, flagged by valid.

    strict: the declared number of verses must be that of the text, too.
    """
    names = {"title": "poem_title", "author": "poet_name", "id": "poem_id", "explanation": "overall_explanation", "raw_explanation": "verses_explanation"}
    verses, tags = lines.numbered_verses("poem_verses"), values.three_tags("tags")
    out = df.withColumn("_t", tags).withColumn("_v", verses).withColumn("poem_text", F.array_join("_v", "\n"))
    valid = F.col("_t").isNotNull()
    if strict:
        valid = valid & (F.size("_v") == values.first_integer("verse_count"))
    out = out.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumns({"meter": F.col("_t.meter"), "genre": F.col("_t.genre"), "era": F.col("_t.era")})
    return out.drop("_t", "_v", "poem_verses").withColumnsRenamed(names | {"era": "poet_era"})


def counted_poems(df: DataFrame) -> DataFrame:
    """U8: four tags, lines paired, an odd last line left out; only rows whose declared number of verses is the text's."""
    tags = values.comma_parts("poem_tags", 4)
    out = df.withColumn("_t", tags).withColumns({n: F.col("_t")[k] for k, n in enumerate(("genre", "poem_type", "meter", "rhyme"))})
    out = out.withColumn("poem_verses", values.first_integer("poem_count")).withColumn("poem_text", lines.pair_lines("poem_text", "drop"))
    return out.where(lines.count_lines("poem_text") == F.col("poem_verses")).drop("_t", "poem_count").withColumnRenamed("poem_tags", "tags")


def emotional_poems(df: DataFrame) -> DataFrame:
    """U9."""
    return df.withColumn("emotion", values.mapped("emotion", EMOTIONS)).withColumnsRenamed({"poem": "poem_text", "verses": "poem_verses", "era": "poet_era", "emotion": "genre"})


def filed_poems(df: DataFrame) -> DataFrame:
    """An era that names no age is a location; a first line that is a heading goes."""
    age = F.col("era").contains("عصر") | F.col("era").contains("المخضرمون")
    out = df.withColumn("location", F.when(~age, F.col("era"))).withColumn("era", F.when(age, F.col("era")))
    out = out.withColumn("poem", F.when(F.col("poem").contains("صدر"), lines.drop_first_line("poem")).otherwise(F.col("poem")))
    return out.withColumnsRenamed({"poem_name": "poem_title", "era": "poet_era", "poem": "poem_text"})


def scraped_poems(df: DataFrame) -> DataFrame:
    """Cleaning by site, tags by what they name, countries out of eras; rows without a poem or with a junk era go."""
    site, poem, era = F.col("source"), F.col("poem"), F.col("era")
    tidy = F.replace(F.regexp_replace(poem, "\n+", "\n"), F.lit("\t"), F.lit(""))
    out = df.withColumn("poem_title", F.when(site == "diwan", before_dash("title")).otherwise(F.col("title")))
    out = out.withColumn("poem", F.when(site == "adab", tidy).when(site == "poets_gate", lines.pair_lines("poem", "leave")).otherwise(poem))
    out = out.withColumns(values.tag_classes("tags"))
    out = out.where(era.isNull() | ~era.isin(*JUNK_ERAS)).where("poem is not null")
    country = era.isin(*SCRAPED_COUNTRIES)
    out = out.withColumn("location", F.when(country, era)).withColumn("era", F.when(~country, era))
    return out.drop("title", "poem_no_diacritics").withColumnsRenamed({"id": "poem_id", "poem": "poem_text", "poet": "poet_name", "era": "poet_era", "poet_page_url": "poet_url"})


def _single_tab(c: str):
    return F.replace(F.col(c), F.lit("\t\t"), F.lit("\t"))


def adab_world(df: DataFrame) -> DataFrame:
    """U12a."""
    out = df.withColumns({"poet_name": trim_ws("poet_name"), "poet_era": trim_ws("poet_era"), "verses_formatted": _single_tab("verses_formatted")})
    return out.drop("poet_era_key", "poet_era_period", "poet_birth_death", "page", "url", "image_url", "verses.1", "content_scraped", "vocabulary", "explanation", "post_id", "theme").withColumnsRenamed({"title": "poem_title", "verses_formatted": "poem_text", "full_url": "poem_url"})


def arapoet(df: DataFrame) -> DataFrame:
    """Meters get their prefix, but the one that is a type of poem."""
    meter = F.coalesce(F.col("meter").cast("string"), F.lit("nan"))
    named = F.when((meter == COLUMN_METER) | meter.startswith("بحر"), meter).otherwise(F.concat(F.lit("بحر "), meter))
    out = df.withColumns({"meter": named, "poem_type": F.when(meter == COLUMN_METER, COLUMN_METER), "hemistichs_format": _single_tab("hemistichs_format")})
    return out.withColumnsRenamed({"title": "poem_title", "author": "poet_name", "poet era": "poet_era", "hemistichs_format": "poem_text"}).drop("verse_count", "explanation")


def mawsooaa(df: DataFrame) -> DataFrame:
    """Meters that stand among themes move to meter."""
    moved = F.col("theme").isin(*THEME_METERS)
    meter = F.when(moved, F.concat(F.lit("بحر "), F.col("theme"))).otherwise(F.col("meter")) if "meter" in df.columns else F.when(moved, F.concat(F.lit("بحر "), F.col("theme")))
    out = df.withColumns({"meter": meter, "theme": F.when(~F.coalesce(moved, F.lit(False)), F.col("theme")), "hemistichs_format": _single_tab("hemistichs_format")})
    out = out.drop("age_period", "age_id", "verse_count", "poet_gender", "poem_length", "word_count", "poem_id")
    return out.withColumnsRenamed({"rhyme_letter": "rhyme", "poetry_type": "poem_language", "theme": "genre", "hemistichs_format": "poem_text", "source_file": "source"})


# Keys of the public collections, and of three layouts that have no public name.
UNIFIERS = {
    "AraPoems": grouped_lines,
    "Arabic PCD": hemistich_columns,
    "Arabic Poetry Dataset (6th - 21st century)": category_split,
    "Ashaar": quoted_poems,
    "numbered_poems": numbered_poems,
    "Arabic Poetry Dataset": counted_poems,
    "Arabic-Poetry-Melody": emotional_poems,
    "filed_poems": filed_poems,
    "scraped_poems": scraped_poems,
    "adab_world": adab_world,
    "arapoet": arapoet,
    "mawsooaa": mawsooaa,
}


def unify_all(sources: dict[str, DataFrame], layouts: dict[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """(the union, keys without a unifier, which are left out).

    layouts: keys of the caller's own, and the unifier's key each goes by. Columns are the
    sorted union of all; what a source lacks is null. poem_id is a row's place by source
    and text, from 1; missing verse counts are counted.
    """
    of = {k: UNIFIERS.get((layouts or {}).get(k, k)) for k in sources}
    known = {k: of[k](df).withColumn("dataset_name", F.lit(k)) for k, df in sources.items() if of[k]}
    unknown = [k for k in sources if not of[k]]
    if not known:
        raise ValueError("no source has a unifier")
    strings = [df.select(*(F.col(f"`{c}`").cast("string").alias(c) if t != "array<string>" else F.col(f"`{c}`") for c, t in sorted(df.drop("poem_id").dtypes))) for df in known.values()]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), strings)
    all_ = missing.with_columns(all_, "poem_verses", "poem_text")
    count = F.coalesce(values.first_integer("poem_verses"), F.when(F.col("poem_text").isNotNull(), lines.count_lines("poem_text").cast("long")))
    all_ = all_.withColumn("poem_verses", count).withColumn("poem_text_no_diacritics", strip_marks("poem_text"))
    # numbered within buckets of (source, hash of the text), whose first numbers are what the buckets before hold
    all_ = all_.withColumn("_h", F.md5(F.coalesce("poem_text", F.lit("")))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = all_.groupBy("dataset_name", "_b").agg(F.count("*").alias("_c"))
    # 4096 rows a source at most
    sizes = sizes.select(F.col("dataset_name").alias("_of"), F.col("_b").alias("_in"), F.coalesce(F.sum("_c").over(Window.orderBy("dataset_name", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    columns = sorted(c for c in all_.columns if c not in ("_h", "_b"))
    order = Window.partitionBy("dataset_name", "_b").orderBy("_h", F.to_json(F.struct(*columns)))
    numbered = all_.withColumn("_n", F.row_number().over(order)).join(F.broadcast(sizes), (F.col("dataset_name") == F.col("_of")) & (F.col("_b") == F.col("_in")))
    return numbered.withColumn("poem_id", F.col("_n") + F.col("_base")).select("poem_id", *columns), unknown


def normalise_eras(df: DataFrame, countries: list[str] = values.COUNTRIES) -> DataFrame:
    """Eras that name a country move to an empty location, then eras and meters get their usual names."""
    era, location = F.col("poet_era"), F.col("location")
    country = F.coalesce(era.isin(*countries), F.lit(False))
    blank = missing.is_missing(location)
    return df.withColumns({"location": F.when(country & blank, era).otherwise(location), "poet_era": F.when(~country, values.normal_era(era)), "meter": values.normal_meter("meter")})


def valued_columns(df: DataFrame, group: str, value) -> list[str]:
    """Columns in which a group has any value; one row reaches the driver."""
    own = df.where(F.col(group) == value)
    names = [c for c in df.columns if c != group]
    row = own.agg(*(F.max((~missing.is_missing(c)).cast("int")).alias(c) for c in names)).first()
    return [c for c in names if row[c]]
