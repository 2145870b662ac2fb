"""Documents through toxicity, near-duplicate, repeated-passage and packing stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
in the folder all executors share and reread as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm import packing, simhash, suffixes, toxicity
from loomspark.llm.store import Workspace


def drop_toxic(spark, docs, sf_dir):
    """Documents that the field, fitted on labels, holds for toxic go.

    Null and empty texts and rows that repeat others are scored like any; all columns stay."""
    model = toxicity.train(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))
    clash = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c in ("score", "predicted")}
    scored = toxicity.score(docs.withColumnsRenamed(clash), model, spans=False).where("predicted = 0")
    return scored.select(*(F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns))


def one_of_each_group(spark, docs, sf_dir):
    """Of documents that near copies (0.8 of their 5-word shingles) connect, one stays: the smallest
    doc_id's, then the smallest text hash's; a document without an id only where none has one.

    Null texts are empty, and texts without a word are copies of each other; all columns stay."""
    linked = simhash.similar(docs.select("doc_id", "text"))
    first = linked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("_doc"), F.col("f.th").alias("_th"))
    rows = docs.withColumn("_own", F.xxhash64("text"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_th")), "left_semi")
    # rows of one id and one text are copies too
    least = F.min(F.struct(*(c for c in docs.columns if c != "doc_id"))).alias("f")
    return kept.groupBy("doc_id", "_own").agg(least).select("doc_id", "f.*").select(*docs.columns)


def cut_repeats(spark, docs, sf_dir):
    """Texts lose passages of over 50 words that occur elsewhere, all copies of them; texts of which nothing is left go.

    Null and empty texts stay as they are; n_chars, where there is one, is counted anew;
    all other columns stay, whatever their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    safe = docs.select("doc_id", "text", F.col("text").isNull().alias("_c"), *(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(others)))
    out = suffixes.remove(safe, keep=tuple(safe.columns[2:]), words=51).where("n_removed < n_bytes or n_removed = 0")

    def mended(batches):
        import pyarrow as pa

        for b in batches:
            # a cut within a character leaves a part of it, which goes too
            texts = [None if null else x.decode("utf-8", "ignore") for x, null in zip(*(b.column(k).to_pylist() for k in (1, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[3:]], ["doc_id", "text", *b.schema.names[3:]])

    schema = T.StructType([safe.schema["doc_id"], T.StructField("text", T.StringType()), *safe.schema.fields[3:]])
    rows = out.select("doc_id", "kept", *safe.columns[2:]).mapInArrow(mended, schema)
    back = {c: F.col(f"_c{k}") for k, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(back[c].alias(c) for c in docs.columns))


def pack(spark, docs, sf_dir):
    """Sequences of 1024 ids, mixed by source. A null text is empty; rows that repeat others are packed like any."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("repeated_passages", cut_repeats), ("packing", pack)]
#: The stages can't be told in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        ws.drop(*(n for n in ws.names() if n != f"{k}-{name}"))
    return docs
