"""Duplicates, repeats, licenses, toxicity, neighbours, images: against brute force and planted cases."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import components, images, licenses, neighbours, simhash, suffixes, toxicity
from loomspark.llm.store import Workspace, numbered

EDGE = [None, "", "a", "same text", "same text", "x" * 5000, "word " * 2000, "é中  mixed", "A b\tC\x0bd e"]


def edge_docs(spark, more=()):
    rows = [(k, t, "x", 1) for k, t in enumerate([*EDGE, *more])] + [(3, "same text", "x", 1), (None, "null key", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score int")


# --- SimHash ---


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code_is_perfect():
    table, near, count = simhash.golay()
    assert sorted(collections.Counter(count.tolist()).items()) == [(1, 277), (6, 1771)]
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 200)
    codes, n = simhash.near_codewords(words)
    for w, own, k in zip(words, codes, n, strict=True):
        assert len(set(own[:k].tolist())) == k


@pytest.mark.parametrize("bits", range(5))
def test_keys_meet_within_four_bits(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    (ka, oa), (kb, ob) = simhash.keys_of(a), simhash.keys_of(b)
    sa, sb = [set() for _ in a], [set() for _ in b]
    for k, o in zip(ka.tolist(), oa.tolist(), strict=True):
        sa[o].add(k)
    for k, o in zip(kb.tolist(), ob.tolist(), strict=True):
        sb[o].add(k)
    assert all(x & y for x, y in zip(sa, sb, strict=True))


def test_links_of_large_keys():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for b in base]))
    u, v = simhash.links_of(np.zeros(len(fps), np.int64), fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        label = np.array([label[r].min() for r in near])
    roots = dict(zip(u.tolist(), v.tolist(), strict=True))
    signed = fps.view(np.int64)
    groups = collections.defaultdict(set)
    for k, x in enumerate(signed.tolist()):
        groups[roots.get(x, x)].add(label[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label.tolist()))


def test_simhash(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    more = []
    for _ in range(30):
        own = [rng.choice(words) for _ in range(300)]
        more.append(" ".join(own))
        for _ in range(3):
            own = own[:]
            own[rng.randrange(300)] = "changed"
            more.append(" ".join(own))
    df = edge_docs(spark, more)
    got = simhash.link(df.where("doc_id is not null")).collect()
    docs = [(r.doc_id, r.text) for r in df.where("doc_id is not null").collect()]
    fps = np.array([fingerprint(t) for _, t in docs], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.array([d for d, _ in docs])
    for _ in range(len(docs)):
        label = np.array([label[r].min() for r in near])
    want = sorted(zip([d for d, _ in docs], fps.view(np.int64).tolist(), label.tolist(), strict=True))
    assert sorted((r.doc_id, r.fp, r.component_id) for r in got) == want
    assert simhash.link(df.limit(0)).count() == 0
    assert simhash.link(df).count() == df.count()


def test_components(spark):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(300)]
    loose = [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)]
    star = [(5000, 5001 + k) for k in range(500)]
    df = spark.createDataFrame(chain + loose + star, "u long, v long").repartition(7)
    got = {r.u: r.v for r in components.components(Workspace(spark, "t"), df).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in chain + loose + star:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in parent if top(x) != x}


@pytest.mark.parametrize("few", [0, components.FEW])
def test_few_links_take_no_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    ws = Workspace(spark, "t")
    chain, star = [(k, k + 1) for k in range(40)], [(200, k) for k in range(-60, -20)]
    df = spark.createDataFrame(chain + star + [(7, 7)], "u long, v long").repartition(4)
    got = sorted(map(tuple, components.components(ws, df).collect()))
    assert got == sorted([(k, -60) for k in (200, *range(-59, -20))] + [(k, 0) for k in range(1, 41)])
    assert ("forest" in ws.names(), set(ws.names()) <= {"links0", "forest"}) == (bool(few), bool(few))


def test_numbered(spark):
    df = spark.createDataFrame([(k % 3, k, k % 5 if k % 4 else None) for k in range(500)], "a int, b int, n int")
    got = sorted((r.pos, r.a, r.b, r.before_n) for r in numbered(Workspace(spark, "t"), df, ["a", "b"], "x", ("n",)).collect())
    want, total = [], 0
    for pos, (a, b, n) in enumerate(sorted((k % 3, k, k % 5 if k % 4 else 0) for k in range(500))):
        want.append((pos, a, b, total))
        total += n
    assert got == want


# --- repeated passages ---


def brute_removal(texts, width):
    blobs = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + width] for b in blobs for i in range(len(b) - width + 1))
    out = []
    for b in blobs:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                cover[i] += 1
                cover[i + width] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        out.append((len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(90), text(120), text(70)]
    docs = [text(rng.randint(20, 200)) for _ in range(25)]
    for k in range(20):
        p = passages[k % 3]
        cut = rng.randint(0, 60)
        docs.append(text(rng.randint(0, 40)) + p[cut : len(p) - rng.randint(0, 60)] + text(rng.randint(0, 40)))
    docs += [docs[3], docs[3], "ab" * 600, "ab" * 600 + "c", "z" * 399, "z" * 399, "q" * 401, passages[0] + passages[0]]
    return docs


@pytest.mark.parametrize("large", [suffixes.LARGE, 2])
def test_suffix_dedup(spark, large):
    texts = [*EDGE, *repeated_texts()]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, doc string")
    got = suffixes.remove(df, large=large, keep=("doc",)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_removal(texts, 400)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        at, left = 0, b""
        for s in r.removed:
            left += raw[at : s["from"]]
            at = s["to"]
        assert left + raw[at:] == bytes(r.kept) and r.doc == "x"


@pytest.mark.parametrize("large", [suffixes.LARGE, 3])
def test_passages_are_told_beside_the_bytes(spark, large):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 150))) for _ in range(30)]
    p = [[word() for _ in range(n)] for n in (50, 51, 52, 60, 90)]
    texts += [" ".join([texts[k % 30], *own, texts[(k + 3) % 30]]) for own in p for k in range(rng.randint(2, 9))] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.remove(df, texts=False, passages=51, large=large).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_removal(texts, 400)
    words = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    for r, t, w in zip(got, texts, words, strict=True):
        gone = {k for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for k in range(i, i + 51)}
        # each word with the blank after it, where there is one
        assert r.n_passage_bytes == sum(len(w[k]) + (k + 1 < len(w)) for k in gone), t


def test_long_texts_go_in_pieces(spark, monkeypatch):
    texts = repeated_texts(3)
    texts = [" ".join(texts), " ".join(texts[5:9]), texts[20] + texts[21]]
    buf, offs = np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])])
    whole = {(int(p), s) for _, p, a, b in zip(*suffixes.anchors(buf, offs, 400), strict=True) for s in range(a, b + 1)}
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    parts = [x for x in suffixes.pieces(buf, offs, 400)]
    assert len(parts) > 5 and {(int(p), s) for x in parts for _, p, a, b in zip(*x, strict=True) for s in range(a, b + 1)} == whole


def test_suffix_dedup_repeated_rows_and_null_keys(spark):
    t = repeated_texts()[0] * 3
    rows = [(1, t), (1, t), (None, "x" * 450), (None, "y" * 450), (2, "z" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffixes.remove(df, texts=False).collect())
    assert got == sorted((a, b) for a, b, *_ in brute_removal([t for _, t in rows], 400))
    assert suffixes.remove(df.limit(0)).count() == 0


def test_cover_takes_any_two_places():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    assert (suffixes._shifts() >= 0).all()


def test_cover_sort_is_lexicographic():
    rng = np.random.default_rng(7)
    text = np.concatenate([np.tile(rng.integers(97, 99, 90), 12), rng.integers(97, 100, 900)]).astype(np.uint8)
    at = rng.choice(len(text) - 500, 300, replace=False)
    ranks = suffixes.CoverRanks(text, 400)
    order, lcp = ranks.sort(at, np.zeros(300, int), 400)
    blobs = [text[p : p + 400].tobytes() for p in at]
    assert [blobs[k] for k in order] == sorted(blobs)
    for x, y, n in zip(order[:-1], order[1:], lcp[1:], strict=True):
        a, b = blobs[x], blobs[y]
        assert n == next((k for k in range(400) if a[k] != b[k]), 400)


# --- licenses ---


def test_licenses(spark):
    more = [
        "Released under the MIT License. under the MIT license",
        "Licensed under CC BY-NC 4.0.",
        "license mit the under released",
        "under the MIT. license",
        "licensed " + "x " * 40 + "apache license, Version 2.0",
        "Subject to the terms of the Mozilla Public License, version 2",
        "This work is licensed under the GNU General Public License version 3",
        "the MIT license, under which it was released",
    ]
    df = edge_docs(spark, more)
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    n = len(EDGE)
    assert (got[n].n_base, got[n].first_word, got[n].last_word, got[n].base_labels, got[n].labels, got[n].score) == (2, 1, 5, "mit", "mit", 1.0)
    assert (got[n + 1].base_labels, got[n + 1].labels) == ("cc-by-nc", "cc-by-nc")
    assert (got[n + 2].n_base, got[n + 2].labels, got[n + 2].score) == (0, "", 0.0)  # the words of a notice, but no name
    assert (got[n + 6].labels, got[n + 6].score) == ("gpl-3", 1.0) and (got[n + 7].labels, got[n + 7].score) == ("mit", 1.0)
    assert (got[n + 3].n_base, got[n + 3].first_word) == (1, 0)
    assert got[n + 4].base_labels == "apache-2" and got[n + 4].n_base == 1
    assert got[n + 5].labels == "mpl-2" and got[n + 5].base_labels == "" and 0.8 <= got[n + 5].score < 1
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].labels == "" and got[0].key == "x"
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_other_licenses_get_no_label(spark):
    texts = [
        "This work is licensed under the GNU General Public License version 2",
        "This work is licensed under the GNU Lesser General Public License version 3",
        "Licensed under the Creative Commons Attribution license",
        "Licensed under the Creative Commons Attribution NoDerivs license",
        "subject to the terms of the Eclipse Public License version 2.0",
        "released under the BSD license",
        "The band released an album under the label; no license applies",
        "Licensed under the Apache License, Version 1.1",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.labels, r.score) for r in licenses.scan(df).orderBy("doc_id").collect()] == [("", 0.0)] * len(texts)


def test_license_of_a_very_long_text(spark):
    notice = "released under the MIT license"
    rows = [(0, "word " * 300_000 + notice + " word" * 1000), (1, "under the license mit released " * 50_000), (2, notice), (2, notice)]
    got = [(r.doc_id, r.n_words, r.labels, r.first_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(0, 301_005, "mit", 300_001), (1, 250_000, "", None), (2, 5, "mit", 1), (2, 5, "mit", 1)]


def test_license_templates_are_an_index(spark):
    rng = random.Random(14)
    mit = [t for label, t, *_ in licenses.TEMPLATES if label == "mit"][-1]
    words = mit.split()
    assert len(words) > 150

    def changed(share):
        held = words.index("included") - 4  # the phrase that names it stays
        return " ".join("other" if rng.random() < share and not held <= k < held + 8 else w for k, w in enumerate(words))

    texts = [mit, "x " * 777 + changed(0.05) + " y" * 50, changed(0.6), mit, " ".join(words[: len(words) // 2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("_h1", F.lit(2))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[k].labels for k in range(5)] == ["mit", "mit", "", "mit", ""] and got[0].score == 1.0 and 0.8 <= got[1].score < 1 and got[0]._h1 == 2
    many = [(f"t{k}", " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(200))) for k in range(60)]
    lines = [len(licenses.scan(df, templates=t)._jdf.queryExecution().analyzed().toString().splitlines()) for t in (many[:2], many)]
    assert lines[0] == lines[1]  # the plan has no more operators for more templates
    own = spark.createDataFrame([(k, f"a b {t} c") for k, (_, t) in enumerate(many)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(own, templates=many).collect()} == {k: f"t{k}" for k in range(60)}


# --- toxicity ---


def toxic_corpus(n=600, seed=8):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["grunk", "vexor", "zlymf"]
    out = []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        out.append((k, " ".join(own), int(toxic)))
    return out


def test_expectations_given_some_word_is_toxic():
    rng = np.random.default_rng(15)
    e, move = rng.normal(size=(2, 3)), rng.normal(size=(2, 2))
    real = np.array([[True] * 3, [True, True, False]])
    one, step = toxicity._dense(np.where(real, e, 0), real, move)
    got, pairs = toxicity.given_some(one, step, real, np.array([0, 0]), 1)
    total, want, want_pairs = 0.0, np.zeros((2, 3)), np.zeros((2, 2, 2, 2))
    for bits in itertools.product((0, 1), repeat=5):
        rows = [bits[:3], bits[3:]]
        w = np.exp(sum(e[r, k] * b for r, row in enumerate(rows) for k, b in enumerate(row)) + sum(move[a, b] for row in rows for a, b in itertools.pairwise(row)))
        if any(bits):
            total += w
            for r, row in enumerate(rows):
                for k, b in enumerate(row):
                    want[r, k] += w * b
                for k, (a, b) in enumerate(itertools.pairwise(row)):
                    want_pairs[r, k, a, b] += w
    assert np.allclose(got[real], (want / total)[real])
    assert np.allclose(pairs[0], want_pairs[0] / total) and np.allclose(pairs[1, 0], want_pairs[1, 0] / total)


def test_toxicity(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows] + [(9001, None, 1), (9002, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = sum(got[k].predicted == y for k, _, y in held)
    assert right / len(held) > 0.97
    for k, t, y in held:
        for s in got[k].toxic_spans:
            assert t[s["from"] : s["to"]][:4] in ("grun", "vexo", "zlym")
        if y and got[k].predicted:
            assert got[k].toxic_spans
    assert got[9001].predicted == 0 and got[9001].toxic_spans == [] and 0 <= got[9002].score <= 1
    flags = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in flags.items())
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), nothing).count() == 0
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} <= {0, 1}


def test_a_task_fits_the_field(spark, monkeypatch):
    import os

    def fit(texts, labels):
        return toxicity.Model({t: float(n) for t, n in zip(texts, labels, strict=True)}, rest=float(os.getpid()))

    monkeypatch.setattr(toxicity, "fit", fit)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int").repartition(4)
    model = toxicity.train(docs, labels)
    assert model.rest != os.getpid()  # the driver holds no texts
    assert model.weights == {f"text {k}": float(k % 2) for k in range(40) if zlib.crc32(str(k).encode()) % 5}


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(9)
    model = toxicity.Model({}, rest=-1.3, move=rng.normal(size=(2, 2)))
    for _ in range(20):
        n = int(rng.integers(1, 9))
        places = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
        values = rng.normal(size=len(places)) * 2
        ev = np.full(n, model.rest)
        ev[places] = values
        weight = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=n):
            s = sum(ev[k] for k in range(n) if path[k]) + sum(model.move[a, b] for a, b in itertools.pairwise(path))
            for k in range(n):
                weight[k, path[k]] += np.exp(s)
        want = weight[:, 1] / weight.sum(1)
        got = toxicity.chain_marginals(model, [places], [values], [n])[0]
        assert np.allclose(got, want[places])


def test_lower_case_keeps_places():
    assert len(toxicity.lowered("İstanbul ABC")) == len("İstanbul ABC")


# --- neighbours ---


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.3).astype(float)
    v[7] = v[100]
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v)]
    rows += [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] * 16, 1), (None, v[0].tolist(), 1), (5400, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = neighbours.search(df).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 100))
    found = total = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = set(np.lexsort((np.arange(3000), d))[:10].tolist())
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id])
        assert own[["score", "vec_id"]].values.tolist() == sorted(own[["score", "vec_id"]].values.tolist())
        found += len(best & set(own.vec_id))
        total += 10
    assert found / total >= 0.9
    few = neighbours.search(df.where("vec_id < 4"))
    assert few.where("query_id = 0").count() == 3
    assert neighbours.search(df.limit(0)).count() == 0


def test_neighbours_broadcast_nothing(spark, monkeypatch):
    """Queries are as many as the blocks of the table have it; they once met them through a broadcast of all pairs."""
    for name, n in (("BLOCK", 32), ("BATCH", 3), ("ASKED", 8)):
        monkeypatch.setattr(neighbours, name, n)
    plans = []
    monkeypatch.setattr(neighbours.Workspace, "result", lambda ws, df: plans.append(df._jdf.queryExecution().toString()) or ws.save(df, "result"))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [1.0] * 5), (301, [2.0] * 5)]
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=4).collect()}
    assert "Broadcast" not in plans[0]
    for q in range(0, 300, 10):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert [got[q, r] for r in range(1, 5)] == np.argsort(d)[:4].tolist()
    assert got[300, 1] == 301 and (300, 2) not in got


def test_neighbours_ties_and_lone_vectors(spark):
    # twelve vectors at the same distance: the smaller keys win; a few of another length, spread thinly over the blocks
    rows = [(0, [1.0, 0.0, 0.0])] + [(k, [1.0, 3.0, 4.0] if k % 2 else [1.0, 4.0, -3.0]) for k in (40, 7, 12, 30, 29, 11, 8, 21, 33, 9, 10, 50)]
    rows += [(100, [0.5] * 5), (101, [900.0] * 5), (102, [-7.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got[:10] == [(0, n + 1, k, 5.0) for n, k in enumerate([7, 8, 9, 10, 11, 12, 21, 29, 30, 33])]
    assert [x[2] for x in got[10:]] == [102, 101]


# --- images ---


def test_images(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(250, 64))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(300, v[3].tolist()), (301, v[3].tolist()), (350, None), (400, [0.0] * 64), (450, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = images.search(df.withColumns({c: F.lit(1) for c in ("id", "v", "n", "bits", "query_id")}), every=10).collect()
    own = {r.query_id for r in got if r.query_id == r.image_id}
    assert len(own & set(range(0, 250, 10))) >= 23  # recall of 0.9 or more over 25 edited crops
    assert {(r.query_id, r.image_id, r.n_rows) for r in got if r.query_id == 300} == {(300, 3, 3)}
    assert all(r.query_id == r.image_id or r.query_id == 300 for r in got)
    assert images.search(df.limit(0)).count() == 0


def test_small_images_have_no_corner():
    images_ = [None, np.zeros((0, 0)), np.ones((3, 3)), np.ones((64, 5)), np.ones(7), np.ones((64, 64))]
    i, place, bits = images.describe(images_)
    assert len(i) == len(place) == len(bits) == 0


def test_a_crop_keeps_the_corners_of_its_part():
    rng = np.random.default_rng(12)
    big = images._smooth(images._smooth(rng.uniform(0, 255, (300, 400))))
    i, place, bits = images.describe([big, big[100:200, 150:280]])
    own, crop = ({(round(x), round(y)): b.tobytes() for (x, y, scale, _), b in zip(place[i == k], bits[i == k], strict=True) if scale == 1} for k in (0, 1))
    inside = {(x - 150, y - 100): b for (x, y), b in own.items() if 165 <= x < 265 and 115 <= y < 185}
    assert len(inside) > 20 and sum(crop.get(at) == b for at, b in inside.items()) >= 0.9 * len(inside)
    # eight times the area has about eight times the corners
    assert 6 < len(own) / len(images.describe([big[:100, :150]])[0]) * 2 and len(own) > 500


def test_image_copies_are_those_of_all_descriptor_pairs(spark):
    rng = np.random.default_rng(13)
    shown = images.pictures(list(rng.normal(size=(60, 64))))
    shown[7] = shown[3][:, ::-1]  # another image
    asked = {k: images.edited(shown[k], k) for k in range(0, 60, 4)}
    ids = spark.createDataFrame([(k,) for k in range(60)], "id long")
    got = images.copies(ids, ids.where("id % 4 = 0"), lambda b: [shown[k] for k in b.column(0).to_pylist()], lambda b: [asked[k] for k in b.column(0).to_pylist()])
    found = {(r.query_id, r.id): r.consensus for r in got.collect()}
    # every pair of descriptors, whether or not they share a key
    i, place, bits = images.describe(shown)
    want = {}
    for k, image in asked.items():
        _, q_place, q_bits = images.describe([image])
        a, b = np.nonzero(np.bitwise_count(q_bits[:, None] ^ bits[None]).sum(2) <= images.DISTANCE)
        votes = collections.defaultdict(set)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            (qx, qy, qs, qa), (px, py, ps, pa_) = q_place[x], place[y]
            turn, ratio = pa_ - qa, ps / qs
            left = px - ratio * (np.cos(turn) * qx - np.sin(turn) * qy)
            top = py - ratio * (np.sin(turn) * qx + np.cos(turn) * qy)
            for d in range(4):
                votes[i[y], round(np.log(ratio) / np.log(1.5)), round(turn % (2 * np.pi) / (np.pi / 8)) % 16, np.floor(left / 8 + d // 2 / 2), np.floor(top / 8 + d % 2 / 2), d].add(x)
        for (image_id, *_), corners in votes.items():
            want[k, image_id] = max(want.get((k, image_id), 0), len(corners))
    want = {p: n for p, n in want.items() if n >= images.CONSENSUS}
    assert set(found) <= set(want) and all(found[p] <= want[p] + 1 for p in found)
    assert len(found) >= 0.9 * len(want) and sum((k, k) in found for k in asked) >= 0.9 * len(asked)


def test_described_rows_skip_missing(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    render = lambda b: [None if k == 1 else images.pictures([np.arange(64) - 30.0])[0] for k in b.column(0).to_pylist()]
    got = images.descriptors(df, render, "long").select("id").distinct().collect()
    assert [r.id for r in got] == [2]


def test_rows_of_one_vector_id_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.1]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (200, [5.0, 5.0])]
    got = collections.Counter((r.query_id, r.vec_id, round(r.score, 6)) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = collections.Counter((i, j, round(float(np.linalg.norm(np.subtract(v, w))), 6)) for a, (i, v) in enumerate(rows) if i % 100 == 0 for b, (j, w) in enumerate(rows) if a != b)
    assert got == want and sum(got.values()) == 12


def test_many_rows_of_one_document(spark):
    text = " ".join(f"w{k}" for k in range(900))
    rows = [(7 if k % 2 else None, text) for k in range(5000)] + [(k, f"other {k} " * 60) for k in range(8, 12)]
    got = suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string"), texts=False)
    own = [r for r in got.collect() if r.n_bytes == len(text)]
    assert len(own) == 5000 and all(r.n_removed == len(text) and r.n_spans == 1 for r in own)


def test_very_long_texts_of_fingerprints_and_labels(spark):
    long = "word other thing " * 60_000
    got = {r.doc_id: r for r in simhash.link(spark.createDataFrame([(1, long), (2, long + "x"), (3, "short"), (3, "short")], "doc_id long, text string")).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3


def test_images_that_share_parts(spark):
    """Pictures of four quarters, each from one pool: what is told apart are copies from pictures with a quarter in common."""
    rng = np.random.default_rng(31)
    pool = [images.pictures([rng.normal(size=16)], 48)[0] for _ in range(24)]
    parts = np.array([rng.choice(24, 4, replace=False) for _ in range(240)])
    shown = [np.block([[pool[a], pool[b]], [pool[c], pool[d]]]) + rng.normal(0, 2, (96, 96)) for a, b, c, d in parts]
    asked = {k: images.edited(shown[k], k) for k in range(0, 240, 6)}
    ids = spark.range(240)
    got = images.copies(ids, ids.where("id % 6 = 0"), lambda b: [shown[k] for k in b.column(0).to_pylist()], lambda b: [asked[k] for k in b.column(0).to_pylist()]).collect()
    found = {(r.query_id, r.id): r.consensus for r in got}
    own = sum((q, q) in found for q in asked)
    strange = [p for p in found if not set(parts[p[0]]) & set(parts[p[1]])]
    alike = [p for p in found if p[0] != p[1] and p not in strange]
    best = sum(max((n, i) for (q, i), n in found.items() if q == k)[1] == k for k in asked if (k, k) in found)
    print(f"own {own} of {len(asked)}, best {best}, with a common part {len(alike)}, with none {len(strange)}")
    assert own >= 0.95 * len(asked) and best >= 0.95 * own and not strange
