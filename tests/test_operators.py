import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import missing, text
from loomspark.operators import chat, dedup, enrich, evaluation, metrics, sampling, similar, stats, templates


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert similar.common_subsequence(a, b) == lcs(a, b)
    assert dedup.similarity("abcd", "abxd") == 0.75


def greedy(rows, threshold):
    """The pair loop over one bucket's rows (key, text, values) in order."""
    gone = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if i in gone or j in gone:
            continue
        if dedup.similarity(rows[i][1], rows[j][1]) >= threshold:
            gone.add(j if rows[i][2] >= rows[j][2] else i)
    return {rows[k][0] for k in gone}


def test_blocks(spark):
    rows = [(1, "a b c", None, None), (2, "a b c", 1, 1), (3, "a b c", 1, 1), (4, "c b a", None, 1), (5, "x y", 1, None), (6, "other text", 1, 1)]
    df = spark.createDataFrame(rows, "id long, t string, p int, q int")
    kept = {r[0] for r in dedup.near_exact(df, "t", "id", ["p", "q"], 0.9).select("id").collect()}
    assert kept == {2, 4, 5, 6}
    log = {(r.kept, r.dropped) for r in dedup.match_log(df, "t", "id", ["p", "q"], 0.9).collect()}
    assert log == {(2, 1), (2, 3)}


def test_mixed_block_is_greedy(spark):
    words = ["aa", "bb", "cc", "dd", "ee"]
    rng = random.Random(2)
    rows = []
    for k in range(12):
        own = words[:]
        rng.shuffle(own)
        rows.append((k, " ".join(own), rng.choice([None, 1]), 1))
    rows = list({r[1]: r for r in reversed(rows)}.values())[::-1]
    df = spark.createDataFrame(rows, "id long, t string, p int, q int")
    gone = {r[0] for r in dedup.match_log(df, "t", "id", ["p", "q"], 0.7).select("dropped").collect()}
    assert gone == greedy([(k, t, (p is not None) + 1) for k, t, p, _ in sorted(rows)], 0.7)


def test_exact_and_decontaminate(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, ""), (4, " "), (5, None)], "id long, t string")
    assert {r.id for r in dedup.exact(df, "t", "id").collect()} == {1, 3, 5}
    test = spark.createDataFrame([(9, "a\tb")], "id long, t string")
    clean = dedup.decontaminate(df, test, "t")
    assert {r.id for r in clean.collect()} == {3, 4, 5}
    assert dedup.contamination_summary(clean, test, "t").first()["shared"] == 0


def test_cross_split(spark):
    train = spark.createDataFrame([(1, "one two three four"), (2, "two one three four"), (3, "else")], "id long, t string")
    test = spark.createDataFrame([(9, "one two three four")], "id long, t string")
    assert {r.id for r in dedup.cross_split(train, test, "t", "id", 0.7).collect()} == {3}


def test_containing(spark):
    p = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    df = spark.createDataFrame([(1, f"x{p}y"), (2, p.replace("zeta", "z")), (3, None), (4, "see the cat sat on it")], "id long, t string")
    b = spark.createDataFrame([(1, p), (2, "the cat sat"), (3, "no")], "item long, p string")
    assert {tuple(r) for r in dedup.containing(df, b, "t", "id", "p", "item").collect()} == {(1, 1), (4, 2)}


def test_total_row_is_weighted(spark):
    df = spark.createDataFrame([("a", "x" * 10), ("a", "x" * 10), ("b", "x" * 40)], "o string, t string")
    total = [r for r in stats.origins(df, F.col("o"), "t").collect() if r.origin == "TOTAL"][0]
    assert total.avg_chars == 20.0


def test_classes_of_characters_tell_texts_apart(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcdijé") for _ in range(rng.randint(0, 30))) for _ in "ab")
        distance = len(a) + len(b) - 2 * lcs(a, b)
        assert not similar.apart([similar.Pattern(x) for x in similar.by_class(a)], similar.by_class(b), distance)
    names = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(200)]
    texts = [" ".join(rng.choices(names, k=200)) for _ in range(30)]
    near = [t.replace(names[k], "") for k, t in enumerate(texts[:5])]
    met, within = [], similar.Pattern.within_reach
    monkeypatch.setattr(similar.Pattern, "within_reach", lambda *args: met.append(1) or within(*args))
    found = {(i, j) for i, j, _ in similar.close(similar.Block(texts), similar.Block(near), 0.9)}
    assert found == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(near) if similar.similarity(x, y) >= 0.9} and len(found) == 5
    assert len(met) <= 5


def test_words_are_counted_in_time(spark):
    wide = text.WS[1:-1]
    classes = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{int(m[1], 16):08X}", f"[{wide}]"))
    assert all(chr(c).isspace() == bool(classes.match(chr(c))) for c in range(0x110000))
    row = spark.createDataFrame([(1, "Été\u00a0été, été\u2003d'été 12\U0001f600 x\x1cy\u0250")], "id long, t string")
    latin = r"A-Za-z\x{00C0}-\x{024F}"
    assert metrics.repetition(row, "t", "id", latin).first()[1:5] == (6, 5, 1, 2)
    own = spark.range(0, 160, 1, 1).select("id", F.repeat(F.lit("word, other words; "), 5000).alias("t"))
    began = time.perf_counter()
    assert metrics.repetition(own, "t", "id", latin).where("total_words = 15000 and unique_words = 3").count() == 160
    assert time.perf_counter() - began < 8  # 15 million characters in one task


def test_repetition(spark):
    df = spark.createDataFrame([(1, "a a b c"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r for r in metrics.repetition(df, "t", "id", "a-z").collect()}
    r = got[1]
    assert (r.total_words, r.unique_words, r.repeated_words, r.max_word_frequency) == (4, 3, 1, 2)
    assert (round(r.word_repetition_rate, 2), r.unique_word_ratio, round(r.avg_word_frequency, 4)) == (33.33, 0.75, 1.3333)
    assert got[2].word_repetition_rate == 0 and got[3].total_words == 0
    score = spark.range(1).select(metrics.composite(F.lit(3.4032), F.lit(0.9676), F.lit(1.0413))).first()[0]
    assert round(score, 4) == 0.0276


def test_claims_and_quotas(spark):
    df = spark.range(500).withColumn("a", F.when(F.col("id") % 2 == 0, 1))
    claimed = sampling.claim(df, [F.col("a").isNotNull(), F.lit(True)], "id").groupBy("template").count().collect()
    assert {r["template"] for r in claimed} == {0, 1}
    odd = sampling.claim(df, [F.col("a").isNotNull(), F.lit(False)], "id")
    assert odd.where("template = 0 and a is null").count() == 0
    assert odd.where("template = 0").count() == 250
    q = sampling.quotas(df, [F.col("a").isNotNull(), F.lit(True)], 100, "id", taken=[20, 0])
    assert {tuple(r) for r in q.groupBy("template").count().collect()} == {(0, 30), (1, 50)}
    assert q.select("id").distinct().count() == q.count()


def test_positions_are_gapless(spark):
    got = sampling.positions(spark.range(1000), "id")
    assert sorted(r.pos for r in got.collect()) == list(range(1, 1001))


def test_choices(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate("abcabc")], "id long, v string")
    for r in sampling.choices(df, "v", "id").collect():
        assert len(r.choices) == 3 and r.choices[r.correct_choice] == r.v and len(set(r.choices.values())) == 3
    assert sampling.choices(df, "v", "id", strict=True).count() == 0


def test_templates(spark):
    sheet = spark.createDataFrame([("lang, poem_title", "poem_text", "Write {poem_title} in {lang} - now", None, " ")], "placeholder string, output string, msa string, gulf string, levant string")
    row = templates.grouped(sheet).first()
    assert row.inputs == ["lang", "poem_title"] and [v.dialect for v in row.variants] == ["msa"]
    spec = [{"inputs": row.inputs, "output": row.output, "variants": [(v.text, v.dialect) for v in row.variants]}]
    df = spark.createDataFrame([(1, "en", "T", "x\ny", 0), (2, None, "T", "x", 0)], "id long, lang string, poem_title string, poem_text string, template int")
    got = templates.samples(df, spec, "id", "poem_text", "generation").collect()
    assert [(r.id, r.input, r.output) for r in got] == [(1, 'Write "T" in en now', "x\ny")]


def test_chat(spark):
    df = spark.createDataFrame([("a b c", "a b c d e")], "p string, f string")
    row = chat.tokenised(df, "p", "f", tokenizer=lambda ts: [list(range(len(t.split()))) for t in ts]).first()
    assert row.labels == [-100, -100, -100, 3, 4] and row.attention_mask == [1] * 5
    empty = chat.prompt_completion(df, "p", "f", training=False).first()
    assert empty.prompt[0]["content"] == "a b c" and empty.completion == []
    with pytest.raises(ValueError):
        chat.prompt_completion(df, "p", "f", prompt_type="none")
    with pytest.raises(ValueError):
        chat.budget("p", 100, 50)


def test_f_test():
    # F(2, 10) = 4.1028 and F(1, 20) = 4.3512 are the usual 5 % points
    assert abs(evaluation.f_p_value(4.1028, 2, 10) - 0.05) < 1e-4
    assert abs(evaluation.f_p_value(4.3512, 1, 20) - 0.05) < 1e-4


def test_significance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0), ("b", 10.0)], "g string, v double")
    got = evaluation.significance(df, "g", "v")
    assert got["significant"] and got["f"] == pytest.approx(128.0)


def test_enrich(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, p string")
    got = enrich.complete(df, "p", lambda ps: [p.upper() for p in ps], "r")
    assert {r.id: r.r for r in got.collect()} == {1: "A", 2: None, 3: "C"}
    path = f"file://{tmp_path}/out"
    step = lambda d: enrich.complete(d, "p", lambda ps: [p * 2 for p in ps], "r")
    assert enrich.resume(df.where("id < 3"), path, "id", step).count() == 2
    assert enrich.resume(df, path, "id", step).count() == 3
    tries = []

    def flaky(batch):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return batch

    assert enrich.with_retries(flaky, delay=0)([1]) == [1] and len(tries) == 3


def test_rows_by_id(spark):
    out = spark.createDataFrame([("p1_r0", "x"), ("bad", "y"), ("p2_r9", "z")], "oid string, c string")
    base = spark.createDataFrame([(10,), (20,)], "id long")
    assert [(r.id, r.prompt_num, r.c) for r in enrich.rows_by_id(out, base, "oid", "id").collect()] == [(10, 1, "x")]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 * 10).alias("k"))
    got = sampling.row_numbers(df, "k", 8)
    assert sorted((r.pos, r.k) for r in got.collect()) == [(i + 1, 10 * i) for i in range(1000)]
    assert sampling.row_numbers(df.limit(0), "k").count() == 0


def test_zipped(spark):
    a, b = spark.range(5).withColumnRenamed("id", "x"), spark.range(10, 15).withColumnRenamed("id", "y")
    got = enrich.zipped(a, b, "x", "y", "x").collect()
    assert sorted((r.x, r.y) for r in got) == [(k, k + 10) for k in range(5)] and {r.side for r in got} <= {"a", "b"}


def test_matched_names(spark):
    a, b = spark.createDataFrame([("ar_1.json",), ("ar_2.json",)], "n string"), spark.createDataFrame([("en_1.json",)], "n string")
    assert [r.stem for r in enrich.matched_names(a, b, "n").collect()] == ["1.json"]


def test_cross_split_wide(spark):
    held = [(100, "one two three four five six"), (101, "b a"), (102, "one two three four five sic"), (103, None)]
    train = [(1, "two one three four five six"), (2, "a b"), (3, "one two three four five sic"), (4, "far away from all of it"), (5, None), (6, "one two three four five sit")]
    a, b = (spark.createDataFrame(x, "id long, t string") for x in (train, held))
    near = {r.id for r in dedup.cross_split(a, b, "t", "id", 0.7).collect()}
    wide = {r.id for r in dedup.cross_split(a, b, "t", "id", 0.7, wide=True).collect()}
    # 1 shares a bucket with 100; 6 shares none, so neither mode drops it; 2 is too unlike its bucket's text
    assert near == wide == {2, 4, 5, 6}
    # a text whose own bucket's text is too unlike, but another test text is near
    more = spark.createDataFrame([(7, "zeta alpha beta gamma")], "id long, t string")
    tests = spark.createDataFrame([(1, "gamma beta alpha zeta"), (2, "zeta alpha beta gammas")], "id long, t string")
    assert dedup.cross_split(more, tests, "t", "id", 0.9).count() == 1 and dedup.cross_split(more, tests, "t", "id", 0.9, wide=True).count() == 0


def test_similarity_bound():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 15))) for _ in "ab")
        s = dedup.similarity(a, b)
        assert s == (1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)))
        t = dedup.similarity(a, b, 0.8)
        assert t == s if s >= 0.8 else t < 0.8


def test_containing_passages_of_any_length(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "a catalogue of foxes"), (3, None), (4, "")], "id long, t string")
    passages = spark.createDataFrame([(1, "uick brown fox jum"), (2, "fox"), (3, "of foxes"), (4, "missing passage here now"), (5, None), (6, ""), (7, "quick brown fox jumps")], "item long, p string")
    got = {tuple(r) for r in dedup.containing(docs, passages, "t", "id", "p", "item").collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (2, 3), (1, 7)}
    assert dedup.containing(docs, passages.limit(0), "t", "id", "p", "item").count() == 0


def test_exact_claims(spark):
    df = spark.createDataFrame([(k, 1 if k % 2 else None) for k in range(100)], "id long, a int")
    got = sampling.claim_exact(df, [F.col("a").isNotNull(), F.lit(True)], "id", (0.1, 1.0)).groupBy("template").count().collect()
    # 5 of 50; 9 of 95; all 45 or so odd ones that are left; the rest
    first = 5
    assert sum(r["count"] for r in got) == 100 and {r.template for r in got} == {0, 1}
    assert {r.template: r["count"] for r in got}[0] >= first and sampling.claim_exact(df, [F.lit(False)], "id").count() == 0


def test_remaining_names_every_template(spark):
    df = spark.createDataFrame([(0,), (0,), (2,), (None,)], "template int")
    assert {tuple(r) for r in sampling.remaining(df, "template", 12, 4).collect()} == {(0, 1), (1, 3), (2, 2), (3, 3)}


def test_choices_among_many_values(spark):
    df = spark.createDataFrame([(k, f"v{k % 300}") for k in range(900)] + [(1000, None), (1001, " ")], "id long, v string")
    got = sampling.choices(df, "v", "id", strict=True).collect()
    assert len(got) == 900
    for r in got:
        assert len(set(r.choices.values())) == 5 and r.choices[r.correct_choice] == r.v
    assert len({v for r in got for v in r.choices.values()}) == 300


def test_token_budget_and_masks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    long = "some words of a text " * 50
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "id long, t string")
    got = {r.id: r.t for r in chat.token_budget(df, "t", encode, t.decode_batch, longest=160, new_tokens=40, margin=20).collect()}
    assert len(encode([got[1]])[0]) == 100 and long.startswith(got[1]) and got[2] == "short" and got[3] is None
    with pytest.raises(ValueError):
        chat.token_budget(df, "t", encode, t.decode_batch, longest=100, new_tokens=40)
    pairs = spark.createDataFrame([("a b c", "a b c d e"), ("a b c d", "a b")], "q string, f string")
    got = chat.tokenised(pairs, "q", "f", lambda texts: encode(list(texts)), longest=4).collect()
    ids = encode(["a b c d e"])[0]
    assert got[0].input_ids == ids[:4] and got[0].labels == [-100] * 3 + ids[3:4]
    assert got[1].labels == [-100] * len(got[1].input_ids)


def test_score_tests(spark):
    rows = [("m1", 1.0), ("m1", 2.0), ("m1", 3.0), ("m2", 4.0), ("m2", 5.0), ("m2", 7.0)]
    df = spark.createDataFrame(rows, "model string, c double").withColumn("same", F.lit(1.0))
    got = {r.criterion: r for r in evaluation.tests(df, "model", ["c", "same"]).collect()}
    # Student's t of the two samples is 3.1622777, with four degrees of freedom: p = 0.0341094
    assert abs(got["c"].f - 10) < 1e-9 and abs(got["c"].p - 0.0341094) < 1e-6
    assert got["c"].p == evaluation.significance(df, "model", "c")["p"] and got["c"].significant and got["same"].p is None and not got["same"].significant


def test_rounded_total(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "xy"), ("a", "x"), ("b", "xyz\nx")], "o string, t string")
    got = {r.origin: r for r in stats.origins(df, F.col("o"), "t", digits=1).collect()}
    assert got["a"].avg_chars == 1.3 and got["TOTAL"].avg_chars == round((1.3 * 3 + 5) / 4, 1)


def test_prompts_fill_in(spark):
    df = spark.createDataFrame([("era", "t", "p", "now", "text"), ("nothing", "t", "p", "now", "text")], "kind string, title string, poet string, era string, poem string")
    fields = {"poem_title": F.col("title"), "poet_name": F.col("poet"), "poet_era": F.col("era"), "poem_text": F.col("poem"), "target_era": F.lit("then"), "rhyme": F.lit("r"), "meter": F.lit("m"), "target_meter": F.lit("n")}
    got = [r.prompt for r in templates.prompts(df, "kind", templates.CORRUPTIONS, fields).collect()]
    assert "from the style of now into that of then" in got[0] and got[0].endswith("text") and got[1] is None
    for kind in templates.CORRUPTIONS:
        one = templates.prompts(df.limit(1).withColumn("kind", F.lit(kind)), "kind", templates.CORRUPTIONS, fields).first().prompt
        assert "{poem" not in one and "text" in one


def test_signatures_are_cached(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c", 1), (2, "a b c", 1)], "id long, t string, p int")
    for _ in range(2):
        assert [(r.kept, r.dropped) for r in dedup.match_log(df, "t", "id", ["p"], cache=f"file://{tmp_path}/c").collect()] == [(1, 2)]


def test_saves_and_batches(spark, tmp_path):
    df = spark.range(25).select(F.col("id"), F.concat(F.lit("p"), F.col("id")).alias("q"))

    def provider(prompts):
        assert len(prompts) <= 4
        return [p + "!" for p in prompts]

    step = lambda rows: enrich.complete(rows, "q", provider, "a", most=4)
    path = f"file://{tmp_path}/r"
    assert enrich.resume(df.where("id < 10"), path, "id", step, saves=3).count() == 10
    assert {r.a for r in enrich.resume(df, path, "id", step).collect()} == {f"p{k}!" for k in range(25)}


def test_exact_claims_of_thousands_of_templates(spark):
    df = spark.range(3000).select("id", *((F.col("id") % m == 0).alias(f"c{m}") for m in (2, 3, 5, 7)))
    names = ["c2", "c3", "c5", "c7"]
    eligible = [F.col(names[k % 4]) if k % 3 else F.col(names[k % 4]) & F.col(names[(k + 1) % 4]) for k in range(2000)]
    got = {r.id: r.template for r in sampling.claim_exact(df, eligible, "id", (0.3, 1.0)).collect()}
    rows = {i: [i % m == 0 for m in (2, 3, 5, 7)] for i in range(3000)}
    fits = lambda i, k: rows[i][k % 4] and (k % 3 > 0 or rows[i][(k + 1) % 4])
    assert set(got) == {i for i in rows if any(rows[i])} and all(fits(i, k) for i, k in got.items())
    # the first templates' shares, before any pass comes again to what they left
    once = {r.id: r.template for r in sampling.claim_exact(df, eligible[:40], "id", (0.3,)).collect()}
    for k in range(40):
        free = [i for i in rows if fits(i, k) and once.get(i, 99) >= k]
        assert sum(t == k for t in once.values()) == int(0.3 * len(free))
    patterns = sampling.patterns(df, eligible, "id")[0]
    assert patterns.select("pattern").distinct().count() == 16


def test_exact_claims_beyond_the_patterns(spark, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") % 2 == 0).alias("a"), (F.col("id") % 3 == 0).alias("b"))
    counts = lambda: {r.template: r["count"] for r in sampling.claim_exact(df, [F.col("a"), F.col("b")], "id", (0.5, 1.0)).groupBy("template").count().collect()}
    assert sum(counts().values()) == 40
    monkeypatch.setattr(sampling, "PATTERNS", 2)
    assert sum(counts().values()) == 40
    assert sampling.quotas(df, [F.col("a"), F.col("b")], 20, "id").count() == 20


def test_missing_values_at_any_length(spark):
    blank, long = " " * 200_000, "x" * 200_000
    rows = [None, "", " \t", "NaN", " none\n", "[ ]", " {}", "<NA>", "Empty ", blank, blank + "nan", "nan nan", "[]x", blank + "x", long, "nan\nx"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string").select("k", missing.is_missing("x").alias("m")).orderBy("k").collect()
    assert [r.m for r in got] == [True] * 11 + [False] * 5


def shuffles(n, seed, words=7):
    """Rows (key, text, values) of one bucket: the same words in other orders."""
    rng, own = random.Random(seed), [f"w{chr(97 + k) * 3}" for k in range(words)]
    texts = {" ".join(rng.sample(own, words)) for _ in range(4 * n)}
    return [(k, t, rng.choice([None, 1]), rng.choice([None, 1])) for k, t in enumerate(sorted(texts)[:n])]


@pytest.mark.parametrize(("threshold", "pivots", "pairs"), [(0.6, 8, 10**6), (0.75, 1000, 10**6), (0.9, 16, 3)])
def test_large_buckets_are_greedy_too(spark, monkeypatch, threshold, pivots, pairs):
    for name, n in (("BUCKET", 10), ("PIVOTS", pivots), ("PAIRS", pairs)):
        monkeypatch.setattr(dedup, name, n)
    monkeypatch.setattr(similar, "ROWS", 16)
    rows = shuffles(90, 5)
    log = dedup.match_log(spark.createDataFrame(rows, "id long, t string, p int, q int"), "t", "id", ["p", "q"], threshold).collect()
    want = greedy([(k, t, (p is not None) + (q is not None)) for k, t, p, q in rows], threshold)
    assert {r.dropped for r in log} == want and len(log) == len(want)


def test_settling_equals_the_pair_loop():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(2, 9)
        near = {(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4}
        values = [rng.randint(0, 3) for _ in range(n)]
        gone = set()
        for i, j in itertools.combinations(range(n), 2):
            if i not in gone and j not in gone and (i, j) in near:
                gone.add(j if values[i] >= values[j] else i)
        got = dedup.settle(list(enumerate(values)), lambda i, n=n, near=near: [(j, 1.0) for j in range(i + 1, n) if (i, j) in near])
        assert {x for _, x, _ in got} == gone


def test_cross_split_compares_a_text_once(spark, monkeypatch):
    """Each row of a group of copies once met the test texts by itself."""
    met, compared = [], similar.near_copies
    monkeypatch.setattr(similar, "near_copies", lambda a, b, threshold: met.append(a.count()) or compared(a, b, threshold))
    words = [f"word{k}" for k in range(40)]
    near, far, other = " ".join([*words[1:], words[0]]), " ".join(reversed(words)), "something else"
    train = spark.createDataFrame([(k, [near, far, other][k % 3]) for k in range(90)], "id long, t string")
    test = spark.createDataFrame([(0, " ".join(words))], "id long, t string")
    for wide in (False, True):
        left = {r.id for r in dedup.cross_split(train, test, "t", "id", 0.9, wide=wide).collect()}
        assert left == {k for k in range(90) if k % 3}
    assert met == [2, 2]


def test_near_copies_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "ROWS", 8)
    rng, letters = random.Random(11), "abcdefgh é中 "
    base = ["".join(rng.choices(letters, k=rng.choice([1, 5, 30, 200, 900]))) for _ in range(60)]

    def edited(t):
        out = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 8))):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        return "".join(out)

    train = [*enumerate(base), (900, base[0]), (901, None), (902, " "), (903, "x" * 20_000)]
    test = [(k, edited(t)) for k, t in enumerate(base[:40])] + [(800, base[3]), (801, None), (802, "x" * 19_000), (803, base[3])]
    a, b = (spark.createDataFrame(x, "id long, t string") for x in (train, test))
    for threshold in (0.9, 0.7):
        got = {(r.id, r.other, round(r.similarity, 9)) for r in dedup.near_copies(a, b, "t", "id", threshold).collect()}
        full = [(i, j, dedup.similarity(x, y)) for i, x in train for j, y in test if x and y and x.strip() and y.strip()]
        assert got == {(i, j, round(s, 9)) for i, j, s in full if s >= threshold} and len(got) > 20
    assert dedup.near_copies(a.limit(0), b, "t", "id").count() == 0


def test_texts_move_to_few_tiles(spark, monkeypatch):
    """Each block once met each block as a row of its own: 48 and 24 blocks of two texts moved as 2304 blocks."""
    monkeypatch.setattr(similar, "ROWS", 2)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcd ", k=40)) for _ in range(96)]
    a = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "g int, k long, t string")
    b = spark.createDataFrame([(0, k, t[:-1]) for k, t in enumerate(texts[:48])], "g int, k long, t string")
    out = similar.near_copies(a, b, 0.9)
    assert {(r.k, r.other) for r in out.collect()} >= {(k, k) for k in range(48)}
    full = {(i, j) for i, j in itertools.combinations(range(96), 2) if similar.similarity(texts[i], texts[j]) >= 0.6}
    assert [(r.k, r.other) for r in similar.within(a, 0.6).orderBy("k", "other").collect()] == sorted(full) and full
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_classes_rule_out_many_pairs_at_once(monkeypatch):
    """Pairs of a block once went through a comparison of their own, character by character, unless counts told."""
    rng = random.Random(6)
    names = ["".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choices(names, k=300)) for _ in range(50)]
    near = [t.replace(names[k], "", 9) for k, t in enumerate(texts[:40])]
    met, apart = [], similar.apart
    monkeypatch.setattr(similar, "apart", lambda *args: met.append(1) or apart(*args))
    a, b = similar.Block(texts), similar.Block(near)
    assert [(i, j) for i, j, _ in similar.close(a, b, 0.9)] == [(k, k) for k in range(40)]
    assert len(similar.counted(a, np.arange(50), b, 0.9)[0]) > 1000 and not met


def test_classes_rule_out_no_copy():
    rng = random.Random(3)
    for letters, size, threshold in itertools.product(("ab", "eeeeexyzÄ漢字かな\U0001f600", "abcdefgh é中 ", "etaoinshrdlu ."), (1, 40, 300), (0.6, 0.9)):
        base = ["".join(rng.choices(letters, k=rng.randint(size // 2, size))) for _ in range(8)]
        near = []
        for t in base * 2:
            out = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 6))):
                at = rng.randrange(len(out) + 1)
                out[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            at = rng.randrange(len(out) + 1)  # many that stand together, too
            near.append("".join(out[:at] + rng.choices(letters, k=rng.choice([0, len(t) // 12])) + out[at:]))
        x, y = [*base, "", letters], [*near, "", "q"]
        want = {(i, j): similar.similarity(u, v) for i, u in enumerate(x) for j, v in enumerate(y) if similar.similarity(u, v) >= threshold}
        a, b = similar.Block(x), similar.Block(y)
        i, j, told = similar.sieve(a, np.arange(len(x)), b, threshold, 0)
        assert told and set(zip(i.tolist(), j.tolist(), strict=True)) >= set(want)
        assert {(i, j): s for i, j, s in similar.close(a, b, threshold)} == want


def test_tiles_of_long_texts_are_smaller(spark, monkeypatch):
    """A tile of long texts once had as many blocks as others, whose pairs cost far less."""
    for name, value in (("ROWS", 2), ("SPAN", 4), ("LEAST", 1), ("LONG", 10)):
        monkeypatch.setattr(similar, name, value)
    a = spark.createDataFrame([(0, k, f"{k:02}" * 20) for k in range(12)], "g int, k long, t string")
    short = a.selectExpr("g", "k", "left(t, 2) AS t")
    parts = [similar.near_copies(x, x, 0.9).rdd.getNumPartitions() for x in (a, short)]
    assert parts[0] >= 36 > parts[1]
    assert {(r.k, r.other) for r in similar.near_copies(a, a, 0.9).collect()} >= {(k, k) for k in range(12)}


def test_bounds_leave_few_pairs():
    rng = random.Random(12)
    syllables = ["".join(rng.choices("abcdefghijklmnop", k=2)) for _ in range(60)]
    text = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(120))
    a, b = similar.Block([text() for _ in range(40)]), similar.Block([text() for _ in range(40)])
    assert sum(len(similar.candidates(a, i, b, 0.9)) for i in range(40)) < 40 * 40 / 20
    assert all(i in similar.candidates(a, i, a, 0.9) for i in range(40))


def test_similarity_bounds_never_lose_a_pair():
    rng = random.Random(21)
    for _ in range(300):
        a = "".join(rng.choices("abcd", k=rng.randint(65, 160)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        b = "".join(b) if rng.random() < 0.8 else "".join(rng.choices("abcd", k=rng.randint(65, 160)))
        full = 2 * lcs(a, b) / (len(a) + len(b))
        for least in (0.5, 0.7, 0.8, 0.9, full):
            got = dedup.similarity(a, b, least)
            assert got == full if full >= least else full - 1e-12 <= got < least


def test_labels_by_characters(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    turns = [("system", "Be kind."), ("user", "hello  é中 there"), ("assistant", "hi — ça va? \n\n"), ("user", None), ("assistant", ""), (None, "x"), ("assistant", "end" * 50)]
    long = [(r, f"turn {k} ünd so") for k in range(300) for r in ("user", "assistant")]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None), (4, long)], "id int, messages array<struct<role: string, content: string>>")
    got = {r.id: r for r in chat.labelled(df, "messages", path).collect()}
    for key, messages in ((1, turns), (2, []), (4, long)):
        text, learnt = "", []
        for role, content in messages:
            text += f"<|im_start|>{role or ''}\n"
            begin = len(text)
            text += f"{content or ''}<|im_end|>\n"
            if role == "assistant":
                learnt.append((begin, len(text)))
        e = own.encode(text, add_special_tokens=False)
        want = [i if any(a <= x and y <= b for a, b in learnt) else -100 for i, (x, y) in zip(e.ids, e.offsets)]
        assert got[key].input_ids == e.ids and got[key].labels == want
    assert got[3].input_ids is None and sum(x != -100 for x in got[4].labels) > 300 and got[2].labels == []
    short = {r.id: r for r in chat.labelled(df, "messages", path, longest=5).collect()}
    assert short[4].labels == got[4].labels[:5]


def test_budget_in_ids(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = [None, "", "short", "word " * 300, "🙂" * 100, "é中🙂 mixed " * 60]
    got = [r.t for r in chat.within_budget(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", path, longest=40, new_tokens=8, margin=12).orderBy("id").collect()]
    for x, y in zip(texts, got):
        if x is None or len(own.encode(x, add_special_tokens=False).ids) <= 20:
            assert x == y
        else:
            assert x.startswith(y) and 0 < len(own.encode(y, add_special_tokens=False).ids) <= 20
    with pytest.raises(ValueError):
        chat.within_budget(spark.range(1), "id", path, longest=10)


def test_short_passages_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FEW", 4)
    texts = [(k, f"begin w{k} middle x{k % 5} end") for k in range(30)]
    passages = [(100 + k, p) for k, p in enumerate([f"w{k}" for k in range(12)] + ["x1 e", "nd", "absent", "", None, "begin w7 middle x2"])]
    got = {(r.doc_id, r.item_id) for r in dedup.containing(spark.createDataFrame(texts, "doc_id long, t string"), spark.createDataFrame(passages, "item_id long, p string"), "t", "doc_id", "p", "item_id").collect()}
    assert got == {(i, j) for i, t in texts for j, p in passages if p and p in t}


def test_kinds_by_template_number(spark):
    got = [r.k for r in spark.range(-1, 9).select(templates.corruption_kind(F.col("id").cast("int")).alias("k")).collect()]
    assert got == [None, *templates.CORRUPTION_KINDS, None] and len(templates.CORRUPTION_KINDS) == 8
