"""Streams with state, crawls, sinks with names, stored states, the index of known texts, replies in pieces."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import known, replies, sketches
from loomspark.sources import crawl, named, readers
from loomspark.streaming import events, retries


def test_each_request_once_over_restarts(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def service(prompts, tries):
        for p, t in zip(prompts, tries):
            open(f"{asked}/{p}-{t}", "x").close()  # an attempt that was made before would fail here
        return [RuntimeError("busy") if t <= int(p) % 3 else f"r{p}" for p, t in zip(prompts, tries)]

    def load(first, last, extra=()):
        rows = [(k, f"2024-01-01 {k // 60:02}:{k % 60:02}:00") for k in range(first, last)] + list(extra)
        spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("at"), F.col("id").cast("string").alias("prompt")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    load(0, 40, [(5, "2024-01-01 00:06:00"), (None, "2024-01-01 00:06:00")])
    run = lambda: retries.drained(retries.retried(events.source(spark, f"{tmp_path}/in"), "id", "prompt", "at", service, attempts=3, delay=0.1, lanes=3, most=7), f"{tmp_path}/out", f"{tmp_path}/check", trigger="100 milliseconds", patience=120)
    got = {r.id: (r.reply, r.attempts, r.error) for r in run().collect()}
    assert got == {str(k): (f"r{k}", k % 3 + 1, None) for k in range(40)}
    load(40, 60, [(7, "2024-01-01 00:39:00")])  # a known id again
    rows = run().collect()
    assert len(rows) == 60 and {r.id for r in rows} == {str(k) for k in range(60)}


def test_requests_that_fail_to_the_last(spark, tmp_path):
    spark.createDataFrame([(k, None if k == 3 else f"p{k}") for k in range(6)], "id long, prompt string").withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")

    def service(prompts, tries):
        if any(p == "p1" for p in prompts):
            raise OSError("down")  # the whole call
        return [p + "!" for p in prompts]

    stream = retries.retried(events.source(spark, f"{tmp_path}/in"), "id", "prompt", "at", service, attempts=2, delay=0.05, lanes=1, most=1)
    got = {r.id: (r.reply, r.attempts, r.error) for r in retries.drained(stream, f"{tmp_path}/out", f"{tmp_path}/check", trigger="100 milliseconds").collect()}
    assert got == {"1": (None, 2, "down"), "3": ("!", 1, None)} | {str(k): (f"p{k}!", 1, None) for k in (0, 2, 4, 5)}


def test_crawl_goes_on_where_it_stopped(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(page, attempt):
        open(f"{asked}/{page}-{attempt}", "x").close()
        if attempt == 1 and page % 5 == 0:
            raise TimeoutError("slow")
        return None if page % 4 == 0 else f"body {page}"

    run = lambda last: crawl.crawl(spark, fetch, 10, last, f"{tmp_path}/out", f"{tmp_path}/check", per_batch=20, delay=0.1, lanes=2, patience=120)
    assert {r.id for r in run(49).collect()} == set(range(10, 50))
    # further ids, the same checkpoint: nothing is asked for a second time, or the file of that attempt would exist
    first = {os.path.basename(x).split("-")[0] for x in glob.glob(f"{asked}/*")}
    got = {r.id: (r.body, r.attempts) for r in run(1000).where("id <= 49").collect()}
    assert got == {k: (None if k % 4 == 0 else f"body {k}", 2 if k % 5 == 0 else 1) for k in range(10, 50)} and len(first) == 40


def test_one_array_by_all_tasks(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('"x",\n'), F.col("id").cast("string"))).alias("t"))
    path = f"{tmp_path}/rows.json"
    named.one_array(df, path)
    assert os.path.isfile(path) and sorted((r["id"], r.get("t")) for r in json.load(open(path))) == sorted((r.id, r.t) for r in df.collect())
    assert readers.json_document(spark, path, schema="id long, t string").count() == 1000
    named.one_array(df.limit(0), path)
    assert json.load(open(path)) == [] and [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["rows.json"]
    with pytest.raises(FileExistsError):
        named.one_array(df, path, mode="error")


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") == 57, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        named.one_array(bad, f"{tmp_path}/rows.json")
    with pytest.raises(Exception, match="broken"):
        named.file_per_key(bad.withColumn("k", F.lit("a")), "k", f"{tmp_path}/keys")
    assert os.listdir(tmp_path) == []


def test_a_file_for_each_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(named, "PART_ROWS", 50)
    rows = [(k, x) for x, n in (("a b/c", 300), ("é,ü", 5), (None, 3), ("p%q=r", 4)) for k in range(n)]
    named.file_per_key(spark.createDataFrame(rows, "id long, k string"), "k", f"{tmp_path}/keys")
    got = {f: sorted(json.loads(x)["id"] for x in open(f"{tmp_path}/keys/{f}")) for f in os.listdir(f"{tmp_path}/keys") if not f.endswith(".crc")}
    assert got == {"a_b_c.jsonl": list(range(300)), "é_ü.jsonl": list(range(5)), "null.jsonl": [0, 1, 2], "p%q=r.jsonl": [0, 1, 2, 3]}


def test_states_of_loads_unite(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 40_000).alias("x"))
    for k in range(3):
        sketches.store(sketches.states(df.where(F.col("x") % 3 == k), ["g"], {"x": F.col("x")}, {"x": F.col("x")}), f"{tmp_path}/s", f"day{k}")
    for loads, n in ((None, 20_000), (["day0"], 20_000 / 3)):
        for r in sketches.united(spark, f"{tmp_path}/s", ["g"], loads).collect():
            assert abs(r.distinct_x - n) < 0.03 * n
            # a third of the rows repeats the first 20,000 numbers, so the median lies at 15,000
            assert abs(r.quantiles_x[1] - 15_000) < 0.03 * 40_000
    # a load that comes again replaces its states
    sketches.store(sketches.states(df.where("x = 1"), ["g"], {"x": F.col("x")}, {"x": F.col("x")}), f"{tmp_path}/s", "day1")
    assert sketches.united(spark, f"{tmp_path}/s", ["g"], ["day1"]).first().distinct_x == 1
    assert sum(r["rows"] for r in sketches.united(spark, f"{tmp_path}/s", ["g"]).collect()) == 40_000 + 2


def test_known_texts_meet_in_their_buckets(spark, tmp_path):
    index = known.Index(spark, f"file://{tmp_path}/known", buckets=8)
    old = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id") % 700).alias("t"))
    assert index.add(old, "id", F.col("t")).count() == 700
    new = spark.createDataFrame([(5000, "t1"), (5001, "new"), (5002, "new"), (5003, None)], "id long, t string")
    joined = index.unknown(new, "id", F.col("t"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # the exchanges are the new rows': none lies over the index's scan
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Bucketed: true")
    assert [r.id for r in index.add(new, "id", F.col("t")).collect()] == [5001]
    assert index.add(new, "id", F.col("t")).count() == 0 and index.rows().count() == 701
    # another session finds the files
    spark.sql(f"DROP TABLE {index.name}")
    again = known.Index(spark, f"file://{tmp_path}/known", buckets=8)
    assert again.rows().count() == 701 and again.unknown(new, "id", F.col("t")).count() == 0


def test_pieces_of_replies(spark):
    rng = random.Random(4)
    whole = {"a": 'x {"id": "1", "t": "br{ace\\" }"} , {"n": {"m": [1, {}]}} y', "b": '{"id": 2} {bad} {"open": "', "c": "nothing", "d": None, "e": '"quoted" {"k": "\\\\"}'}
    rows = []
    for name, text in whole.items():
        cuts = sorted(rng.sample(range(len(text)), min(9, len(text) - 1))) if text else []
        for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, None])):
            rows.append((name, k, text[i:j] if text else None))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in replies.assembled(spark.createDataFrame(rows, "r string, k int, p string"), "r", "k", "p").collect())
    assert got == [
        ("a", 1, '{"id":"1","t":"br{ace\\" }"}', None),
        ("a", 2, '{"n":{"m":[1,{}]}}', None),
        ("b", 1, '{"id":2}', None),
        ("b", 2, "{bad}", "no JSON"),
        ("b", 3, '{"open": "', "cut off"),
        ("e", 1, '{"k":"\\\\"}', None),
    ]


def test_workspaces_delete_what_was_written(spark, tmp_path):
    from loomspark.operators.scratch import workspace, written

    with workspace(spark) as path:
        assert written(spark.range(5), "rows").count() == 5
        at = path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path
        assert os.path.isdir(at) and len(os.listdir(at)) == 1
        with workspace(spark) as inner:
            written(spark.range(2), "rows")
        assert not os.path.exists(inner.removeprefix("file://")) and os.path.isdir(at)
    assert not os.path.exists(at)


def test_first_offsets_are_those_of_the_whole_text():
    import public_tokenizers
    from loomspark.operators import chat

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    parts = ["word", " ", "  ", "\n", "'ll", "<|endoftext|>", "é中", " 1234", "...", "x" * 300, " " * 90, "<|endo"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 400)))
        for n in (1, 5, 65):
            assert chat.first_offsets(path, text, n)[:n] == chat._tokenizer(path).encode(text, add_special_tokens=False).offsets[:n]
    # a long text is not encoded whole
    assert len(chat.first_offsets(path, "some words " * 10_000, 65)) == 65


def test_labels_come_in_pieces(spark, monkeypatch):
    import public_tokenizers
    from loomspark.operators import chat

    rows = spark.createDataFrame([(k, [("user", "q"), ("assistant", "some words " * (k % 4))]) for k in range(40)] + [(40, None)], "id long, m array<struct<role string, content string>>").coalesce(1)
    whole = {r.id: (r.input_ids, r.labels) for r in chat.labelled(rows, "m", public_tokenizers.path("byte_bpe_50k.json")).collect()}
    monkeypatch.setattr(chat, "PIECE", 50)
    assert {r.id: (r.input_ids, r.labels) for r in chat.labelled(rows, "m", public_tokenizers.path("byte_bpe_50k.json")).collect()} == whole and len(whole) == 41


def test_requests_due_together_share_a_timer():
    class Waiting(dict):
        exists = lambda self: bool(len(self))
        containsKey = lambda self, k: k in self
        updateValue = dict.__setitem__

    class Values:
        getCurrentProcessingTimeInMs = lambda self: 1000

    import pandas as pd

    timers, lane = [], retries.Lane(lambda p, t: [RuntimeError("busy")] * len(p), 3, 0.2, 2.0, 1000)
    lane.waiting, lane.handle = Waiting(), type("Handle", (), {"registerTimer": lambda self, due: timers.append(due)})()
    rows = pd.DataFrame({"id": [str(k) for k in range(50)], "prompt": ["p"] * 50})
    assert [len(x) for x in lane.handleInputRows(0, [rows], Values())] == [0]
    assert timers == [1200] and len(lane.waiting) == 50
    # one that waits is not asked again
    assert [len(x) for x in lane.handleInputRows(0, [rows], Values())] == [0]
    assert timers == [1200]
