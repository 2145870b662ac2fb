"""The prefix trie, the divergence audit and the exact search: against brute force on rows with every oddity."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import covertrees, divergence, tries
from loomspark.llm.store import Workspace

# --- the prefix trie ---

TURNS = "conv_id long, turn long, role string, text string, depth int, node string"


def rebuilt(rows):
    """{c: turns} after the exchange of first turns, by the contract."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0], y[1].encode(), y[2].encode()))] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    base = lambda c: c - int(np.fmod(c, 5))
    return {c: own.get(base(c), [])[: h[c]] + own[c][h[c] :] for c in own}


def trie_of(convs):
    """The contract's rows by walking all prefixes."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        sub = below(p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], sum(not kids[q] for q in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def trie_rows(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in tries.query(spark, str(tmp_path)).collect()), key=lambda r: (r[0], r[1]))


def test_trie_equals_brute_force(spark, tmp_path):
    rng, rows = random.Random(1), []
    for c in range(-7, 40):
        n = rng.choice([0, 1, 2, 3, 5, 8, 9, 16, 17, 33])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é" * 3, "", None, "long " * 200])) for t in range(n)]
    for c in (50, 51, 52, 55, 60):  # copies, turns without a number, ties, repeated rows, a null key
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    rows += [(61, None, "user", "z"), (61, None, "user", "a"), (61, 3, "b", "tie"), (61, 3, "a", "tie"), (61, 3, "a", "tie"), (61, -1, None, None), (None, 0, "user", "lost")]
    assert trie_rows(spark, rows, tmp_path) == trie_of(rebuilt(rows))


def test_trie_of_nothing_and_of_one(spark, tmp_path):
    assert trie_rows(spark, [], tmp_path / "none") == []
    rows = [(3, 0, "user", "x")]
    assert trie_rows(spark, rows, tmp_path / "one") == trie_of(rebuilt(rows))


def test_trie_of_long_and_many_equal_conversations(spark, tmp_path):
    rows = [(c, t, "user", str(t % 7)) for c in range(0, 500, 5) for t in range(20)] + [(1000, t, "user", str(t)) for t in range(300)]
    assert trie_rows(spark, rows, tmp_path) == trie_of(rebuilt(rows))


def test_trie_keeps_its_own_interface(spark):
    ws = Workspace(spark, "t")
    rows = spark.createDataFrame([(1, 0, 5, 2), (1, 1, 6, 3), (2, 0, 5, 2)], "c long, j long, name long, bytes int")
    convs = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "c long, size long")
    nodes, ends = tries.trie(ws, rows, convs)
    got = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved) for r in nodes.collect()}
    assert got == {(0, 1): (None, 3, 1, 1, 2), (1, 1): (1, 2, 1, 1, 2), (2, 1): (1, 1, 0, 1, 0)}
    assert ends.count() == 3


def test_pieces_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 20)
    ends = spark.range(500).select(F.lit(4).cast("long").alias("node"), F.col("id").alias("c")).unionByName(spark.createDataFrame([(9, 12)], "node long, c long"))
    got = {r.node: r.ends_sha256 for r in tries.digests(Workspace(spark, "t"), ends).collect()}
    assert got == {4: hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), 9: hashlib.sha256(b"12").hexdigest()}


# --- the divergence audit ---

DOCS = "doc_id long, lang string, source string, text string, rank int, item string"


def audit_of(rows, least=10, top=10):
    """The contract's rows, group by group and term by term."""
    docs = [(l or "", s or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))) for _, l, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = lambda ds: collections.Counter(w for d in ds for w in d[2] if df[w] >= least)
        probs = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        counts = {s: count([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        p = {s: probs(c) for s, c in counts.items()}
        whole = probs(count(own))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted(((sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], whole[w]), w) for w in kept if counts[s][w] and p[s][w] > whole[w]), key=lambda x: (-x[0], x[1]))[:top]
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pairs)] + [(lang, s, "term", w.decode(), v, k + 1) for k, (v, w) in enumerate(terms)]
    return sorted(out)


def audit_rows(spark, rows):
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], DOCS)
    return sorted(tuple(r) for r in divergence.audit(df).collect())


def odd_docs(n=260):
    rng = random.Random(3)
    words = ["The", "the", "café", "ÉTÉ", "naïve", "x", "don't", "a1b", "中文", "Zeta", "w" * 3000, *(f"t{chr(97 + k)}" for k in range(20))]
    rows = [(k, rng.choice(["en", "de", "", None, "fr"]), rng.choice(["s1", "s2", "Söürce", None, ""]), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for k in range(n)]
    return rows + [(1, "en", "s1", None), (1, "en", "s1", "the the the"), (1, "en", "s1", "the the the"), (None, "xx", "only", "few words"), (None, "en", "silent", ""), (7, "en", "long", "the long " * 30000)]


def test_audit_equals_brute_force(spark):
    rows = odd_docs()
    assert audit_rows(spark, rows) == audit_of(rows)


def test_audit_in_small_chunks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 4)
    monkeypatch.setattr(divergence, "TILE", 2)
    rows = odd_docs(200)
    assert audit_rows(spark, rows) == audit_of(rows)


def test_audit_of_nothing_and_without_kept_terms(spark):
    assert audit_rows(spark, []) == []
    rows = [(1, "en", "a", "one"), (2, "en", "b", "two"), (3, None, None, None)]
    assert audit_rows(spark, rows) == audit_of(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_any_size():
    for total in (3, 10**6, 10**12, 10**15, 10**17):
        n = np.array([2, total // 3, total - 1, total])
        assert divergence.share(n, total).tolist() == [1 + 10**9 * int(x) // total for x in n]
    big = np.array([(1 << 60) + 1, (1 << 60) + 2])
    assert divergence.sums(np.array([0, 0]), big, 1).tolist() == [(1 << 61) + 3]


# --- the exact search ---

VECTORS = "vec_id long, embedding array<double>, score long, rank int"


def search_of(rows, every=50, k=5):
    floor = lambda v: [int(np.floor(256 * x)) for x in v]
    use = [(n, i, floor(v)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in use:
        if i % every == 0:
            got = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, j, w in use if m != n and len(w) == len(v)), key=lambda x: x)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got)]
    return sorted(out)


def search_rows(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in covertrees.search(df, **more).collect())


def clustered(n, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dims) * 0.05).tolist()) for i in range(n)]


ODD = [(0, [1.0] * 8), (0, [1.0] * 8), (50, [0.0] * 8), (100, None), (None, [1.0] * 8), (150, [float("nan")] * 8), (200, [None] * 8), (250, [float("inf")] * 8), (300, [1.0, 2.0]), (301, [1.0, -2.0]), (350, []), (351, []), (400, [-0.001] * 8)]


def test_search_equals_brute_force(spark):
    rows = clustered(400) + ODD
    assert search_rows(spark, rows) == search_of(rows)


def test_search_down_a_deep_tree(spark, monkeypatch):
    for name, n in (("BLOCK", 40), ("FAN", 4), ("SAMPLE", 30), ("BATCH", 3)):
        monkeypatch.setattr(covertrees, name, n)
    # a third of all rows is one vector
    rows = clustered(500, seed=2) + [(1000 + k, [2.0] * 8) for k in range(250)] + ODD
    assert search_rows(spark, rows) == search_of(rows)


def test_search_of_nothing_and_of_huge_numbers(spark):
    assert search_rows(spark, []) == []
    assert search_rows(spark, [(1, [1.0])]) == []
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=4) * 3e6).tolist()) for k in range(120)]
    assert search_rows(spark, rows) == search_of(rows)
    far = [(0, [1e200, 1.0]), (50, [-1e200, 1.0]), (3, [1.0, 1.0])]
    assert [(r[0], r[2]) for r in search_rows(spark, far)] == [(0, 3), (0, 50), (50, 0), (50, 3)]


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_trees_cover_and_separate(n):
    points = np.floor(np.random.default_rng(n).normal(size=(n, 5)) * 50)
    points[n // 2 :] = points[: n - n // 2]  # copies
    tree = covertrees.Tree(points)
    for level, (at, own, radius) in enumerate(zip(tree.at, tree.own, tree.radius, strict=True)):
        assert (np.linalg.norm(points - points[at[own]], axis=1) <= radius[own] + 1e-9).all()
        if level:
            assert (own[at] == np.arange(len(at))).all() and set(tree.at[level - 1]) <= set(at)
            assert (tree.up[level][own] == tree.own[level - 1]).all()


def test_trees_prune():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16)) * 400
    points = np.floor(centres[np.arange(2000) % 20] + rng.normal(size=(2000, 16)) * 4)
    seen = []
    best = covertrees.Best(5, np.full(20, -np.inf))
    best.offer, offer = lambda s, keys: (seen.append(int(np.isfinite(s).sum())), offer(s, keys)), best.offer
    covertrees.dual(covertrees.Tree(points[:20]), np.arange(20), covertrees.Tree(points), np.arange(2000), np.arange(2000), best)
    assert sum(seen) < 20 * 2000 / 3
    scores = points[:20] @ points.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    assert (best.score == -np.sort(-scores, axis=1)[:, :5]).all()
