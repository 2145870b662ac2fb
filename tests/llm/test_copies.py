"""The pipeline's near copies and repeated passages, by words, against brute force."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from loomspark.llm import copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def some_words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_texts(rng):
    texts = [None, "", " \n", "one two", "One  two", "one three"]
    for k in range(40):
        own = some_words(rng, 150)
        texts.append(" ".join(own))
        for _ in range(4):
            new = own[:]
            for _ in range(rng.randint(1, 6)):
                new[rng.randrange(len(new))] = "changed"
            texts.append(" ".join(new))
    # a large group around one text
    own = some_words(rng, 150)
    for _ in range(120):
        new = own[:]
        for _ in range(rng.randint(0, 5)):
            new[rng.randrange(len(new))] = rng.choice("xyz")
        texts.append(" ".join(new))
    return texts


def test_near_copies_equal_brute_force(spark):
    texts = near_texts(random.Random(11))
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    df = documents(spark, enumerate(texts))
    got = {r.doc_id: r.component_id for r in copies.link(df).collect()}
    assert got == dict(enumerate(label))
    kept = corpus_pipeline.one_of_each_group(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert copies.link(df.limit(0)).count() == 0


def passages_gone(texts, n=51):
    """Words left of each text where runs of n words that occur elsewhere go."""
    words = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(12)
    texts = [None, "", "a b"]
    for n in (49, 50, 51, 52, 55, 63, 80, 300):
        for size in (1, 4, 7):
            p = [("".join(rng.choice("abcdefghé") for _ in range(size))) for _ in range(n)]
            for blank in (" ", "\n"):
                texts.append(" ".join(some_words(rng, rng.randint(1, 90))) + " " + blank.join(p) + " " + " ".join(some_words(rng, rng.randint(1, 90))))
    whole = some_words(rng, 60)
    texts += [" ".join(whole), " " + " ".join(whole) + "\n", " ".join(whole[3:] + whole)]
    raw = "".join(rng.choice("中文字母数学") for _ in range(400))
    texts += [f"one {raw} two", f"three {raw}four"]
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, documents(spark, enumerate(texts)), "").collect()}
    want = passages_gone(texts)
    for k, (t, left) in enumerate(zip(texts[:-2], want, strict=False)):
        if left or not (t or "").split():
            assert (out[k] or "").split() == left, k
        else:
            assert k not in out, k
    # a script that does not part words
    assert out[len(texts) - 2].split() == ["one", "two"] and out[len(texts) - 1].split() == ["three", "four"]


def test_only_copies_are_dropped_where_ids_repeat_or_are_missing(spark):
    rng = random.Random(13)
    a, b, c, d = (" ".join(some_words(rng, 60)) for _ in range(4))
    near_a = a + " more"
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, near_a), (3, c), (9, None), (None, "")]
    out = corpus_pipeline.one_of_each_group(spark, documents(spark, rows).repartition(5), "")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()))
    assert got == sorted([(False, 7, near_a), (True, 0, b), (False, 3, c), (False, 7, d), (False, 9, "")])
    twice = [(r.doc_id, r.text, r.lang) for r in out.collect()]
    assert sorted(map(str, twice)) == sorted(map(str, [(r.doc_id, r.text, r.lang) for r in out.collect()]))


def test_keys_follow_the_similarity():
    assert copies.bands_for(0.8) == (5, 28)
    for s in (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0):
        rows, bands = copies.bands_for(s)
        assert (1 - s**rows) ** bands <= copies.MISS * 1.01 and (bands <= copies.MOST_BANDS or rows == 1)


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.8])
def test_pairs_at_the_similarity_are_found(spark, similarity):
    rng = random.Random(int(similarity * 10))
    rows, want = [], {}
    for k in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        other = own[:]
        # the last words differ, as many as the similarity allows or a few more
        a = round(100 - 96 * 2 * similarity / (1 + similarity) - 4) + rng.choice([-1, 0, 0, 1, 3])
        other[100 - a :] = [f"x{rng.randrange(10**6)}" for _ in range(a)]
        x, y = ({" ".join(t[i : i + 5]) for i in range(96)} for t in (own, other))
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        want[2 * k + 1] = 2 * k if len(x & y) / len(x | y) >= similarity else 2 * k + 1
    got = {r.doc_id: r.component_id for r in copies.link(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()}
    assert {k: got[k] for k in want} == want and 20 < sum(k != v for k, v in want.items()) < 150


def test_a_large_group_of_near_copies_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK", 16)
    own = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*own, f"end{k}"])) for k in range(300)] + [(1000 + k, f"other text number {k} of its own kind") for k in range(40)]
    got = {r.doc_id: r.component_id for r in copies.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(300)) and all(got[1000 + k] == 1000 + k for k in range(40))


def test_near_copies_meet_by_golay_keys(spark, monkeypatch):
    """The pipeline's second stage links what fingerprints within four bits tell, though no other key meets."""
    monkeypatch.setattr(copies, "keys_of", lambda h, count, rows, bands: np.arange(len(count) * bands, dtype=np.uint64).reshape(-1, bands) + np.random.default_rng().integers(0, 1 << 62, 1, np.uint64))
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 900)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[1:]), " ".join(words[::-1]), None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in copies.link(rows).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
