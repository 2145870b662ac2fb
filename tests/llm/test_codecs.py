"""Tokenisation, token files, packing: against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import bpe, packing, pretokens, sharding, tokenfiles

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "a", "it's we'll I'd  they've 'tis ''s '", "x\n\n y\t  z　", "日本語 текст 12³ ½ ٣", "🙂🙂 a🙂b", "word " * 3000, " " * 50, "a" * 400, "same", "same", "<|endoftext|> in a text", "tail  "]


def random_texts(n=3000, seed=1):
    rng = random.Random(seed)
    letters = [*"ab'stmdrvel  \n\t1²é 中!?. ́", "'s", "'re", "'ll", "'ve", " "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def joined(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, parts)))]).astype(np.int64)


def test_boundaries_are_the_patterns():
    texts = random_texts()
    buf, offs = joined(texts)
    want, pattern = [], regex.compile(P.PATTERN)
    for t, o in zip(texts, offs, strict=False):
        want += [o + len(t[: m.start()].encode()) for m in pattern.finditer(t) if m[0]]
    assert pretokens.boundaries(buf, offs).tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_encoders_equal_the_libraries(seed):
    texts = random_texts(1500, seed)
    buf, offs = joined(texts)
    own, ends = bpe.codec(RANKS).encode_texts(buf, offs)
    lib, lib_ends = pretokens.library_encoder(JSON)(buf, offs)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = [enc.encode_ordinary(t) for t in texts]
    assert own.tolist() == lib.tolist() == [i for x in want for i in x]
    assert np.diff(ends).tolist() == np.diff(lib_ends).tolist() == list(map(len, want))
    data, where = bpe.codec(RANKS).decode(own)
    assert data.tobytes() == buf.tobytes() and where[-1] == len(buf)


def test_scan_composes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 31, 32, 33, 1000, 5000):
        f, state = rng.integers(0, 4, (n, 4)), 2
        got = pretokens.scan(f, 2)
        for k in range(n):
            assert got[k] == state
            state = f[k, state]


def test_long_words():
    rng = random.Random(4)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = ["".join(rng.choice("abetion") for _ in range(n)) for n in (255, 256, 257, 3000, 30_000)] + ["x" * 5000, "short one"]
    buf, offs = joined(texts)
    own, ends = bpe.Codec(RANKS).encode_texts(buf, offs)
    assert [own[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [enc.encode_ordinary(t) for t in texts]
    own, _ = bpe.Codec(RANKS).encode_texts(*joined(texts[3:4]))
    assert own.tolist() == enc.encode_ordinary(texts[3])


def test_full_table_still_encodes():
    texts = random_texts(800)
    buf, offs = joined(texts)
    enc = pretokens.TextEncoder(bpe.Merger(bpe.read_ranks(RANKS)), bits=6)
    for _ in range(2):
        assert enc(buf, offs)[0].tolist() == bpe.codec(RANKS).encode_texts(buf, offs)[0].tolist()


def docs(spark, texts=TEXTS, keys=None):
    rows = [(k if keys is None else keys[k], t, f"s{k % 3}" if k % 5 else None, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids int")


def test_bpe_operator(spark):
    df = docs(spark)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, RANKS), RANKS).collect()}
    dig = {r.doc_id: r for r in bpe.digest(df, RANKS).collect()}
    for k, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[k].ids == ids and bytes(got[k].decoded) == (t or "").encode()
        assert got[k].byte_offsets == [0, *np.cumsum([len(enc.decode_single_token_bytes(i)) for i in ids]).tolist()]
        assert dig[k].n_tokens == len(ids)
        assert dig[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert dig[k].offsets_crc32 == crc(got[k].byte_offsets)
        assert dig[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest(df.limit(0), RANKS).count() == 0


def library_ids(texts):
    t = Tokenizer.from_file(JSON)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_code_lengths():
    rng = np.random.default_rng(1)
    for limit in (4, 6, 12):
        counts = np.sort(rng.zipf(1.5, 14))[::-1]
        n = tokenfiles.code_lengths(counts, limit)
        assert n.max() <= limit and sum(2.0 ** -int(x) for x in n) == 1.0
    # without a tight limit the cost is that of Huffman's tree
    import heapq

    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((tokenfiles.code_lengths(counts, 14).astype(int) * counts).sum()) == cost
    assert tokenfiles.code_lengths(np.array([0, 5, 0]), 8).tolist() == [0, 1, 0]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_segment_round_trip(n):
    import pyarrow as pa

    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 1000
    counts = np.bincount(ids, minlength=1000)
    lengths = tokenfiles.code_lengths(counts, 16)
    image = tokenfiles.write_segment(pa.array([1, None]), np.array([n, 0]), ids, lengths, tokenfiles.canonical(lengths), 16, zlib.compress(lengths.tobytes()))
    keys, sizes, back = tokenfiles.read_segment(image)
    assert keys.to_pylist() == [1, None] and sizes.tolist() == [n, 0] and back.tolist() == ids.tolist()


def test_token_files(spark, tmp_path):
    keys = [5, 3, 3, 9, 0, 1, 2, 7, 8, 4, 6, 11, 10, 12]
    df = docs(spark, keys=keys)
    segments = tokenfiles.write(df, JSON, out=f"file://{tmp_path}/seg")
    got = sorted((r.key, r.start, r.n_tokens, r.ids) for r in tokenfiles.read(segments).collect())
    want = sorted((k, len(i) + 1, i + [2]) for k, i in zip(keys, library_ids(TEXTS), strict=True))
    assert sorted((k, n, i) for k, _, n, i in got) == want
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(keys)
    assert {(r.key, r.ids_crc32) for r in tokenfiles.digest(segments).collect()} == {(k, crc(i)) for k, _, i in want}
    assert tokenfiles.read(tokenfiles.write(df.limit(0), JSON)).count() == 0


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, None)], "doc_id long, text string")
    got = sorted((r.start, r.key) for r in tokenfiles.read(tokenfiles.write(df, JSON)).collect())
    assert [k for _, k in got] == [None, 1, 2]


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing(spark, weights):
    texts = TEXTS + random_texts(200) + ["long text here " * 900]
    df = docs(spark, texts)
    got = packing.pack(df, JSON, weights=weights).toPandas()
    ids = {k: i + [0] for k, i in enumerate(library_ids(texts))}
    for doc, own in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == crc(ids[doc][at : at + r.length])
            at += r.length
        assert at == len(ids[doc])
    assert set(got.doc_id) == set(ids)
    sizes = []
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        sizes.append(int(own.length.sum()))
    assert sizes[:-1] == [1024] * (len(sizes) - 1) and sizes[-1] <= 1024
    assert sorted(set(got.sequence_id)) == list(range(len(sizes)))
    assert packing.pack(df.limit(0), JSON).count() == 0


def test_windows_keep_the_mixture(spark):
    rng = random.Random(5)
    rows = [(k, "alpha beta gamma " * rng.randint(1, 900), "big" if k % 4 else "small") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, JSON).join(df.select("doc_id", "source"), "doc_id").toPandas()
    size = got[got.source == "small"].length.sum() / got.length.sum()
    by = got.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)["small"].cumsum()
    # whatever the number of windows from the first on, a source is within a turn of each of its queues of its share
    assert (abs(by - size * 1024 * (by.index + 1)) <= 2 * packing.QUANTUM).all()
    pieces = got.groupby("doc_id").size()
    assert (pieces <= got.groupby("doc_id").doc_tokens.first() // packing.QUANTUM + 3).all()


def test_sharding(spark):
    rows = [(k, f"s{k % 3}" if k % 2 else "hot", k % 7) for k in range(1000)] + [(None, None, 1), (5, "s2", 5), (5, "s2", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, shard int")
    got = sharding.interleave(df.withColumn("x", F.col("shard")), 24, keep=("shard", "x")).toPandas()
    assert list(got.columns) == ["doc_id", "x", "shard", "slot"]
    assert len(got) == len(rows)
    by = got.groupby("shard").slot
    assert by.count().max() - by.count().min() <= 1 and len(by) == 24
    assert all(sorted(s) == list(range(len(s))) for _, s in by)
    hot = got[got.doc_id.fillna(1).astype(int) % 2 == 0].groupby("shard").size()
    assert hot.max() - hot.min() <= 2
    assert Counter(got.doc_id.fillna(-1)) == Counter(-1 if r[0] is None else r[0] for r in rows)
    assert sharding.interleave(df.limit(0), 24).count() == 0
    assert sharding.interleave(df.limit(3), 24).count() == 3
