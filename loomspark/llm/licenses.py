"""Operator 2: license scans by exact set-similarity join, in DataFrame operations only."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words of lower-cased text
# Phrases whose places are counted, by label.
BASE = {"apache-2": "apache license version 2", "cc-by-nc": "cc by nc", "mit": "under the mit license"}
# Templates, in the words that projects put into their files, each with the phrases
# that tell it from its likes. A block of text that holds enough of a template's words, and these
# phrases word for word, gets its label.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license", "creative commons attribution sharealike"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license", "either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "permission notice shall be included in all copies"),
]
THRESHOLD = 0.8
LEAST_HALF = 16  # words of half a block, at least


def half_block(words: int) -> int:
    """Half a block for a template of so many words, a power of two: blocks start every half block, so a template's whole lies in one."""
    return max(LEAST_HALF, 1 << (words - 1).bit_length())


def scan(df: DataFrame, text: str = "text", base: dict[str, str] = BASE, templates: list[tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels and score.

    A block's containment of a template is the share of the template's distinct words
    that are among its own; blocks are two to four times as long as the template. Words
    are ordered by how often they occur in all texts, rarest first, those of no template
    before all others. The templates' first words in that order are an inverted index: a
    block can reach the threshold only if it holds one of them (prefix filter). Texts'
    places of indexed words meet the index in an equi join, which gives pairs of block
    and template. A pair goes on if the block has enough words (length filter) and if
    enough words remain on both sides from the common one on (positional filter), and
    is then verified: by its words, and by the template's phrases (a template's items after
    its text, any number of them), which the block must hold word for word. score is the largest containment among the templates that reach
    the threshold, 1 where a base phrase stands, else 0.

    What the plan holds does not grow with the templates but for lists of their words;
    the index, its words and their counts are bounded by the arguments and are all that is
    broadcast or collected. Rows of one text share its blocks, told by 128 bits of hash.
    Null and empty texts have no words; rows stay as they are, repeated ones too; columns
    of these names are replaced.
    """
    spark = df.sparkSession
    phrases = {label: p.split() for label, p in base.items()}
    wanted = [(label, sorted(set(t.split())), half_block(len(t.split())), names) for label, t, *names in templates]
    vocabulary = sorted({w for _, own, _, _ in wanted for w in own})
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in df.columns if c not in new]
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.translate(whole, UPPER, LOWER), BETWEEN), lambda w: w != "")
    texts = df.select(words.alias("_words"), F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit(1), whole).alias("_h2"))

    # global order of the words: as many rows as the vocabulary at most
    hits = F.filter("_words", lambda w: w.isin(vocabulary))
    counted = {r["w"]: r["n"] for r in texts.select(F.explode(hits).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for label, own, half, names in wanted:
        own = sorted(own, key=rank.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        index += [{"w": w, "p": p, "need": need, "half": half, "label": label, "own": own, "names": [f" {x} " for x in names]} for p, w in enumerate(own[: len(own) - need + 1])]
    rows = F.inline(F.from_json(F.lit(json.dumps(index)), "array<struct<w: string, p: int, need: int, half: int, label: string, own: array<string>, names: array<string>>>"))
    indexed = F.broadcast(spark.range(1).select(rows))

    def places(half: int):
        """Places of indexed words, each with the words of the blocks that hold it."""
        first = sorted({x["w"] for x in index if x["half"] == half})
        near = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(first), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
        begin = lambda h: F.greatest(F.floor(h["i"] / half) - 1, F.lit(0)) * half
        return F.transform(near, lambda h: F.struct(h["w"].alias("w"), F.lit(half).alias("half"), F.floor(h["i"] / half).alias("b"), begin(h).alias("begin"), F.slice(F.col("_words"), (begin(h) + 1).cast("int"), F.lit(3 * half)).alias("near")))

    # two sides of each class of length, so the plan grows with its logarithm only
    found = texts.select("_h1", "_h2", F.inline(F.concat(*(places(half) for half in sorted({x["half"] for x in index})))))
    found = found.join(indexed, ["w", "half"])
    at = F.explode(F.filter(F.array(F.col("b"), F.col("b") - 1), lambda b: b >= 0)).alias("b")
    found = found.select("_h1", "_h2", "w", "p", "need", "label", "own", "names", "half", "begin", "near", at)
    written = F.slice("near", (F.col("b") * F.col("half") - F.col("begin") + 1).cast("int"), 2 * F.col("half"))
    block = F.array_distinct(written)
    found = found.withColumn("block", block).where(F.size("block") >= F.col("need"))  # length filter
    ranked = F.array_intersect(F.split(F.lit(" ".join(order)), " "), F.col("block"))
    found = found.withColumn("ranked", ranked).withColumn("q", F.array_position("ranked", F.col("w")).cast("int") - 1)
    found = found.where(1 + F.least(F.size("own") - F.col("p") - 1, F.size("ranked") - F.col("q") - 1) >= F.col("need"))  # positional filter
    found = found.withColumn("common", F.size(F.array_intersect("own", "ranked"))).where("common >= need")
    # words alone don't tell one license's short notice from another's: it names itself
    said = F.concat(F.lit(" "), F.array_join(written, " "), F.lit(" "))
    found = found.withColumn("said", said).where(F.forall("names", lambda x: F.contains(F.col("said"), x)))
    found = found.groupBy("_h1", "_h2").agg(F.collect_set("label").alias("_labels"), F.max(F.col("common") / F.size("own").cast("double")).alias("_share"))

    spoken = sorted({w for p in phrases.values() for w in p})
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(spoken), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())

    def starts(phrase):
        """Word numbers at which the phrase's words stand one after the other: they are neighbours among the hits too."""

        def held(h, k):
            ok = h["w"] == phrase[0]
            for n, w in enumerate(phrase[1:], 1):
                nxt = F.get(F.col("_hits"), k + n)
                ok = ok & F.coalesce((nxt["w"] == w) & (nxt["i"] == h["i"] + n), F.lit(False))
            return F.when(ok, h["i"])

        return F.filter(F.transform("_hits", held), lambda i: i.isNotNull())

    own = {c: f"_own{k}" for k, c in enumerate(kept)}
    docs = df.select(*(F.col(f"`{c}`").alias(a) for c, a in own.items()), words.alias("_words"), F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit(1), whole).alias("_h2"))
    docs = docs.select(*own.values(), "_h1", "_h2", F.size("_words").cast("long").alias("_n"), hits.alias("_hits"))
    for k, phrase in enumerate(phrases.values()):
        docs = docs.withColumn(f"_p{k}", starts(phrase))
    docs = docs.withColumn("_places", F.flatten(F.array(*(F.col(f"_p{k}") for k in range(len(phrases))))))
    labels = F.filter(F.array(*(F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases))), lambda x: x.isNotNull())
    docs = docs.select(*own.values(), "_h1", "_h2", "_n", "_places", labels.alias("_base"))
    return docs.join(found, ["_h1", "_h2"], "left").select(
        *(F.col(a).alias(c) for c, a in own.items()),
        F.col("_n").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return scan(docs.select("doc_id", "text")).drop("text")


def _sql() -> str:
    """The same rows, every block against every template."""
    base = ", ".join(f"('{label}', {[*p.split()]!r})" for label, p in sorted(BASE.items()))
    rows = ", ".join(f"({k}, '{label}', '{w}', {len(set(t.split()))}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)}, {half_block(len(t.split()))}, {[f' {x} ' for x in names]!r})" for k, (label, t, *names) in enumerate(TEMPLATES) for w in sorted(set(t.split())))
    return rf"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
words AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM docs),
phrases(label, words) AS (VALUES {base}),
places AS (
  SELECT d.doc_id, p.label, w.i FROM words w JOIN docs d USING (doc_id) JOIN phrases p ON w.w = p.words[1]
  WHERE d.words[w.i + 1 : w.i + len(p.words)] = p.words),
based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
templates(t, label, w, n, need, half, names) AS (VALUES {rows}),
blocks AS (
  SELECT doc_id, b, t.t, t.label, t.n, t.need, t.half, t.names, t.w
  FROM words JOIN templates t ON words.w = t.w, unnest([i // half, i // half - 1]) AS u(b) WHERE b >= 0),
matched AS (
  SELECT x.doc_id, label, share
  FROM (SELECT doc_id, b, half, names, label, count(DISTINCT w) / n AS share FROM blocks GROUP BY doc_id, b, t, label, n, need, half, names HAVING count(DISTINCT w) >= need) x JOIN docs d USING (doc_id)
  WHERE len(list_filter(names, lambda p: NOT contains(' ' || array_to_string(d.words[b * half + 1 : (b + 2) * half], ' ') || ' ', p))) = 0),
labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM matched UNION SELECT doc_id, label FROM places) GROUP BY doc_id),
scored AS (SELECT doc_id, max(share) AS share FROM matched GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs d LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN scored USING (doc_id)
"""


ORACLE = _sql()
