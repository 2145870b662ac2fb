"""The pipeline's stages and whole, against brute force on a small table, and the registered queries."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from test_copies import passages_gone, shingles, similarity
from test_matching import repeated_texts, toxic_corpus
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomspark.llm import registry, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('sf')}"
    rows = toxic_corpus()
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t, _ in rows]
    # a word's bytes count where it is a long one, so these texts have none of over 64 bytes but single ones
    docs += [(2000 + k, t, "en", "s0", len(t)) for k, t in enumerate(repeated_texts()) if max(map(len, t.split())) <= 64]
    docs += [(3000 + k, docs[k][1], "en", "s1", docs[k][4]) for k in range(5)] + [(4000, None, None, None, None), (4001, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, y, y) for k, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_run_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = {r.doc_id: r.text for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    ids = sorted(clean)
    sets = [shingles(clean[i]) for i in ids]
    label = list(ids)
    for i in range(len(ids)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    left = [i for i, c in zip(ids, label, strict=True) if i == c]
    want = {i: w for i, w in zip(left, passages_gone([clean[i] for i in left]), strict=True) if w or not (clean[i] or "").split()}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert set(got.doc_id) == set(want)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, own in got.sort_values("start").groupby("doc_id"):
        assert own.length.sum() == own.doc_tokens.iloc[0]
        if len(want[i]) == len((clean[i] or "").split()):  # whole texts, to the id
            e = t.encode(clean[i] or "", add_special_tokens=False).ids + [0]
            assert len(e) == own.doc_tokens.iloc[0]
            assert all(zlib.crc32(np.array(e[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        clashing = docs.withColumns({c: F.col("lang") for c in ("score", "doc", "key", "n_bytes", "kept", "_c0", "group")}).drop("n_chars")
        out = stage(spark, clashing, folder)
        assert out.columns == clashing.columns and out.count() > 0, name
        empty = {r.doc_id: r.text for r in out.where("coalesce(text, '') = ''").collect()}
        assert empty.get(4000, "kept in another's place") is None or name == "near_duplicates"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in ("doc_id", "query_id", "lang", "source", "part", "rank", "depth", "conv_id") if c in want.columns]
    want, got = (x.sort_values(keys).reset_index(drop=True) for x in (want, got))
    for c in want.columns:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c


def test_one_query_per_operator():
    assert [k.split("_")[0] for k in registry.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
