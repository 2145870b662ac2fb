"""Operator 3: toxic spans by a linear-chain conditional random field.

The field has two states per word. A word's evidence is the sum of the weights of the
features it carries (the word, its first four to six letters); words that carry none
share one constant, so the chain over a run of them is a power of one 2x2 matrix and
only words with features are stepped through. Forward-backward marginals of those
words are summed into a document's score and give the offending offsets.
"""

from __future__ import annotations

import os
import pickle
import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import portions, tidy

SAMPLE = 6_000  # labelled documents that the field is fitted on, at most
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
CONTEXT = 6  # words either side of a carrier that training looks at
LEAST_ODDS = 2.0  # log odds of toxic documents that a feature must show
CHANCE = 0.02  # expected number of features that pass by chance


def carried(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """weights: of features; rest: evidence of a word without any; move: [from, to]; head: of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    rest: float = -8.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    head: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def evidence(self, word: str) -> float:
        """0 for words that carry no feature."""
        found = [self.weights[f] for f in carried(word) if f in self.weights]
        return sum(found) + self.rest if found else 0.0

    def score(self, total, most):
        z = self.head[0] + self.head[1] * np.log1p(total) + self.head[2] * most
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Evidence(dict):
    """word -> evidence, remembered up to a bound."""

    def __init__(self, model: Model, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.model.evidence(word)
        return out


def chain_marginals(model: Model, places: list[np.ndarray], evidence: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """P(state 1) of the words with features of each text; the others are folded into matrix powers."""
    docs = len(places)
    if not docs:
        return []
    steps = max(map(len, places))
    plain = np.exp(model.move) * np.exp([0.0, model.rest])[None, :]  # one word without features
    values, vectors = np.linalg.eig(plain)
    values, vectors = values.real / values.real.max(), vectors.real
    inverse = np.linalg.inv(vectors)

    def gap(n):  # (docs, 2, 2): n words without features, scaled
        return np.einsum("ij,dj,jk->dik", vectors, values[None, :] ** n[:, None], inverse)

    at, ev, use = np.zeros((docs, steps), np.int64), np.zeros((docs, steps)), np.zeros((docs, steps), bool)
    for d, (p, e) in enumerate(zip(places, evidence, strict=True)):
        at[d, : len(p)], ev[d, : len(p)], use[d, : len(p)] = p, e, True
    before = np.diff(at, axis=1, prepend=-1) - 1
    before = np.where(use, before, 0)
    after = np.array(sizes) - 1 - np.array([p[-1] for p in places])
    step = np.exp(model.move)
    ahead = np.zeros((docs, steps, 2))
    own = np.stack([np.zeros_like(ev), ev], 2)
    own = np.exp(own - own.max(2, keepdims=True))
    x = np.full((docs, 2), 0.5)
    start = np.exp([0.0, model.rest])
    for k in range(steps):
        n = before[:, k]
        if k == 0:
            # a text's first word has no step into it
            lead = np.where(n[:, None] > 0, np.einsum("i,dij->dj", start, gap(np.maximum(n - 1, 0))) @ step, 1.0)
            y = lead
        else:
            y = np.einsum("di,dij->dj", x, gap(n)) @ step
        y = y * own[:, k]
        y = y / y.sum(1, keepdims=True)
        ahead[:, k] = np.where(use[:, k, None], y, x)
        x = ahead[:, k]
    out = np.zeros((docs, steps))
    b = np.ones((docs, 2))
    for k in reversed(range(steps)):
        last = use[:, k] & ~(use[:, k + 1] if k + 1 < steps else np.zeros(docs, bool))
        if last.any():
            b[last] = gap(after)[last].sum(2)
        m = ahead[:, k] * b
        out[:, k] = m[:, 1] / m.sum(1)
        # to the word before: into this word, over the words between
        c = np.einsum("ij,dj->di", step, own[:, k] * b)
        c = np.einsum("dij,dj->di", gap(before[:, k]), c)
        b = np.where(use[:, k, None], c / c.sum(1, keepdims=True), b)
    return [out[d, : len(p)] for d, p in enumerate(places)]


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(model: Model, evidence: Evidence, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, marginals) of the words with features of each text."""
    places, values, sizes, which = [], [], [], []
    for i, text in enumerate(texts):
        words = WORD.findall(lowered(text)) if text else []
        e = np.fromiter(map(evidence.__getitem__, words), np.float64, len(words))
        p = np.flatnonzero(e)
        if len(p):
            places.append(p)
            values.append(e[p])
            sizes.append(len(words))
            which.append(i)
    out = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
    order = np.argsort([len(p) for p in places], kind="stable")
    for k in range(0, len(order), 64):
        ds = order[k : k + 64].tolist()
        for d, m in zip(ds, chain_marginals(model, [places[d] for d in ds], [values[d] for d in ds], [sizes[d] for d in ds]), strict=True):
            out[which[d]] = (places[d], m)
    return out


def alike(docs: list[np.ndarray], vocabulary: list[str], bands: int = 16, rows: int = 6) -> list[int]:
    """A number for each document, equal for near copies: those whose words share a band of minima."""
    times = np.random.default_rng(3).integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    hashes = np.fromiter((crc32(w.encode()) + 1 for w in vocabulary), np.uint64, len(vocabulary))
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[bytes, int] = {}
    for i, words in enumerate(docs):
        h = hashes[np.unique(words)] if len(words) else np.zeros(1, np.uint64)
        low = np.concatenate([(h[:, None] * t[None, :] >> np.uint64(20)).min(0) for t in times.reshape(bands, rows)]).reshape(bands, rows)
        for b, key in enumerate(map(bytes, low)):
            x, y = top(i), top(first.setdefault(key + bytes([b]), i))
            root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(docs))]


def fit(texts: list[str | None], labels: list[int], rounds: int = 120, rate: float = 0.2, penalty: float = 0.02) -> Model:
    """Fit on labelled documents, of whose words no labels are known: a document is toxic if any of its words is.

    The field's likelihood of the documents' labels is climbed. A clean document's words
    are all 0; a toxic document's are what the field itself expects of them, given that
    they are not all 0. For the first rounds only, its words with a feature that is far
    commoner in toxic documents count as 1, so that the climb starts near."""
    y = np.array(labels)
    # words by number, so that a word of many documents is held once
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in WORD.findall(lowered(t))), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    vocabulary = list(number)
    del number
    # near copies say nothing new, so a feature counts once for all of them
    groups: dict[tuple[int, int], list[np.ndarray]] = {}
    for words, label, group in zip(docs, y.tolist(), alike(docs, vocabulary), strict=True):
        groups.setdefault((group, label), []).append(words)
    n1 = sum(label for _, label in groups)
    n0 = len(groups) - n1
    feature: dict[str, int] = {}
    carries = [[feature.setdefault(f, len(feature)) for f in carried(w)] for w in vocabulary]
    toxic, clean = np.zeros(len(feature), np.int64), np.zeros(len(feature), np.int64)
    for (_, label), parts in groups.items():
        own = {f for w in np.unique(np.concatenate(parts)).tolist() for f in carries[w]}
        (toxic if label else clean)[list(own)] += 1
    del groups
    model = Model()
    base = np.log((n1 + 0.5) / (n0 + 0.5))
    model.head = (float(base), 0.0, 0.0)
    if not n1 or not n0:
        return model
    # a likelihood-ratio test of each feature, strict enough for their number
    a, b = toxic, clean
    share = (a + b) / (n1 + n0)
    ratio = 2 * (a * np.log(np.maximum(a, 1e-9) / (n1 * share)) + b * np.log(np.maximum(b, 1e-9) / (n0 * share)))
    odds = np.log((a + 0.1) / (n1 + 0.2)) - np.log((b + 0.1) / (n0 + 0.2))
    passed = np.flatnonzero((ratio >= 2 * np.log(len(a) / CHANCE)) & (odds >= LEAST_ODDS) & (a > 0))
    if not len(passed):
        return model
    names = list(feature)
    chosen = sorted(names[k] for k in passed.tolist())
    del feature, names
    index = {f: k for k, f in enumerate(chosen)}
    useful = {w: own for w, word in enumerate(vocabulary) if (own := [index[f] for f in carried(word) if f in index])}
    hit = np.zeros(len(vocabulary), bool)
    hit[list(useful)] = True
    width, slots = 2 * CONTEXT + 1, 1 + len(PREFIXES)
    feats, gold, real, of = [], [], [], []
    for d, (words, label) in enumerate(zip(docs, y, strict=True)):
        done = -1
        for k in np.flatnonzero(hit[words]).tolist():
            if k <= done:
                continue
            lo = max(0, k - CONTEXT)
            part = words[lo : lo + width]
            done = lo + width - 1
            fs = [useful.get(w, []) for w in part.tolist()]
            feats.append([x + [-1] * (slots - len(x)) for x in fs] + [[-1] * slots] * (width - len(part)))
            gold.append([int(bool(x) and bool(label)) for x in fs] + [0] * (width - len(part)))
            real.append([True] * len(part) + [False] * (width - len(part)))
            of.append(d)
    # a window of every document without any carrier anchors the rest's evidence
    for d, words in enumerate(docs):
        part = words[:width]
        of.append(-1 if y[d] else d)
        feats.append([[-1] * slots] * width)
        gold.append([0] * width)
        real.append([True] * len(part) + [False] * (width - len(part)))
    feats, gold, real, of = np.array(feats), np.array(gold, float), np.array(real), np.array(of)
    told = (of >= 0) & (y[of] == 1)  # windows of toxic documents
    w, rest, move = np.full(len(index) + 1, 1.0), -2.0, np.zeros((2, 2))
    w[-1] = 0
    theta = np.concatenate([w, [rest], move.reshape(-1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair_gold = np.zeros((2, 2))
    both = real[:, 1:] & real[:, :-1]
    for a in (0, 1):
        for b in (0, 1):
            pair_gold[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum()
    free = both[~told].sum()
    scale = real.sum()
    for k in range(1, rounds + 1):
        w, rest, move = theta[: len(index) + 1], theta[-5], theta[-4:].reshape(2, 2)
        e = w[feats].sum(2) + rest
        one, step = _dense(e, real, move)
        pairs = step[both].sum(0)
        if k > rounds // 3:
            gold = np.where(told[:, None], 0.0, gold)
            gold[told], expected = given_some(one[told], step[told], real[told], of[told], len(y))
            pair_gold = expected[both[told]].sum(0)
            pair_gold[0, 0] += free
        d = (gold - one) * real
        g = np.zeros_like(theta)
        g[: len(index) + 1] = np.bincount(np.where(feats < 0, len(index), feats).reshape(-1), np.repeat(d.reshape(-1), slots), len(index) + 1)
        g[len(index)] = 0
        g[-5] = d.sum()
        g[-4:] = (pair_gold - pairs).reshape(-1)
        g = g - penalty * theta
        g[len(index)] = 0
        g /= scale
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        theta[len(index)] = 0
    model.weights = {f: float(theta[k]) for f, k in index.items()}
    model.rest, model.move = float(theta[-5]), theta[-4:].reshape(2, 2).copy()
    model.move -= model.move.max()
    found = find(model, Evidence(model), texts)
    x = np.stack([np.ones(len(y)), np.log1p([p.sum() for _, p in found]), [p.max(initial=0.0) for _, p in found]], 1)
    head = np.array([base, 0.0, 0.0])
    for _ in range(30):  # Newton steps of a ridged logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        head = head + np.linalg.solve(hess, x.T @ (y - p) - 0.5 * head)
    model.head = tuple(float(h) for h in head)
    return model


def given_some(one: np.ndarray, step: np.ndarray, real: np.ndarray, of: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """What `_dense` tells, given that not all words of a window's document (of: its number) are 0.

    A window's words are all 0 with a probability that follows from its transitions, a
    document's with the product over its windows.
    """
    both = real[:, 1:] & real[:, :-1]
    zero = np.where(both, np.log(np.maximum(step[:, :, 0, 0], 1e-300)) - np.log(np.maximum(1 - one[:, :-1], 1e-300)), 0.0).sum(1)
    zero += np.log(np.maximum(1 - one[:, 0], 1e-300))
    some = np.maximum(-np.expm1(np.bincount(of, zero, docs)), 1e-6)[of]
    pairs = step / some[:, None, None, None]
    pairs[:, :, 0, 0] = np.maximum(1 - pairs.sum((2, 3)) + pairs[:, :, 0, 0], 0.0)
    return np.minimum(one / some[:, None], 1.0), pairs


def _dense(e: np.ndarray, real: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(state 1) per word, P(states of each word and the next)) of padded windows."""
    n, t = e.shape
    own, step = np.exp(np.stack([np.zeros_like(e), np.clip(e, -60, 60)], 2)), np.exp(move)
    own = np.where(real[:, :, None], own, 1.0)
    ahead, behind = np.zeros((n, t, 2)), np.ones((n, t, 2))
    ahead[:, 0] = own[:, 0] / own[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        x = (ahead[:, k - 1] @ step) * own[:, k]
        ahead[:, k] = np.where(real[:, k, None], x / x.sum(1, keepdims=True), ahead[:, k - 1])
    for k in range(t - 2, -1, -1):
        x = (behind[:, k + 1] * own[:, k + 1]) @ step.T
        behind[:, k] = np.where(real[:, k + 1, None], x / x.sum(1, keepdims=True), behind[:, k + 1])
    m = ahead * behind
    one = m[:, :, 1] / m.sum(2)
    p = ahead[:, :-1, :, None] * step[None, None] * (own * behind)[:, 1:, None, :]
    return one, p / p.sum((2, 3), keepdims=True)


def held_out(key):
    """The documents that no label is learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents, the first by a hash of their keys, never held-out ones.

    One task fits, and only the model reaches the driver. What that task holds is bounded by
    sample, of keys and of rows: where keys repeat, the first rows by a hash of their texts
    count. Null labels and unmatched rows are left out.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    rows = rows.orderBy(F.xxhash64(F.col("_key").cast("string")), "_key", "_label").limit(sample)
    got = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(rows), "_key")
    got = got.orderBy(F.xxhash64(F.col("_key").cast("string"), "_text"), "_label").limit(sample).coalesce(1)

    def fitted(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (str(r[0]), r[1], r[2] or ""))
        model = fit([r[2] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    # an empty table may have no task at all
    models = got.select("_key", "_label", "_text").mapInArrow(tidy(fitted), "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fit([], [])


def score(df: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """df with score (0 to 1), predicted (1 from 0.5 on) and, if spans is set, toxic_spans.

    toxic_spans (array of struct from, to): character offsets of words whose marginal is
    0.5 or more, in the text as it is. Null and empty texts get the score of a text
    without any evidence. All columns stay, but those of these names are replaced.
    """
    from pyspark.sql import types as T

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if spans:
        added.append(T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))))
    new = {f.name for f in added}
    names = [c for c in df.columns if c not in new]
    schema = T.StructType([f for f in df.schema.fields if f.name not in new] + added)

    def run(batches):
        evidence = Evidence(model)
        for batch in portions(batches, text):
            texts = batch.column(text).to_pylist()
            found = find(model, evidence, texts)
            s = model.score(np.array([m.sum() for _, m in found]), np.array([m.max(initial=0.0) for _, m in found]))
            cols = [*(batch.column(c) for c in names), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
            if spans:
                where = []
                for t, (p, m) in zip(texts, found, strict=True):
                    hit = set(p[m >= 0.5].tolist())
                    where.append([{"from": x.start(), "to": x.end()} for k, x in enumerate(WORD.finditer(lowered(t))) if k in hit] if hit else [])
                cols.append(pa.array(where, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return df.select(*names).mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    model = train(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")
