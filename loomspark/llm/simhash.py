"""Operator 5: SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut in three segments, each padded to 23 bits. Two
fingerprints that differ in four bits or fewer differ in at most two bits over
some pair of segments (the three pairs share 2 * 4 bits). Over that pair either
one segment is equal and the other within 2, or both are within 1. The Golay code
is perfect: every 23-bit word is within 3 of exactly one codeword. So

* words within 2 share a codeword that is within 4 of both (their midpoint's);
* for words x, y within 1, the codeword nearest to x is within 4 of y.

There are one or six codewords within 4 of a word. The keys (equal segment,
near codeword), and (nearest codeword, near codeword) with either segment first,
thus meet for every pair within four bits; candidates that meet are verified.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .store import Workspace, partitions, release, slices, text_buffers, tidy

# The generator polynomial of the (23, 12) Golay code; seed of the shingles' hash.
GOLAY, LENGTH, CHECK = 0xC75, 23, 11
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
DISTANCE = 4
KEYS_PER_BUCKET = 1_500_000
SMALL = 48  # members of a key up to which pairs are compared for many keys at once


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the three bytes of a word, all error patterns of up to 4 bits of each syndrome, how many)."""

    def syndrome(word: int) -> int:
        for k in range(LENGTH - 1, CHECK - 1, -1):
            if word >> k & 1:
                word ^= GOLAY << (k - CHECK)
        return word

    one = np.array([syndrome(1 << k) for k in range(LENGTH + 1)])
    table = np.zeros((3, 256), np.int32)
    for byte in range(3):
        for v in range(256):
            for k in range(8):
                if v >> k & 1:
                    table[byte, v] ^= one[min(8 * byte + k, LENGTH)]
    error = np.zeros(1 << CHECK, np.int32)
    for i in range(LENGTH):
        error[one[i]] = 1 << i
        for j in range(i):
            error[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                error[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    near, count = np.zeros((1 << CHECK, 6), np.int32), np.zeros(1 << CHECK, np.int32)
    for s in range(1 << CHECK):
        found = dict.fromkeys([int(error[s]), *(int(error[s ^ one[i]]) ^ 1 << i for i in range(LENGTH))])
        own = [e for e in found if e.bit_count() <= 4]
        near[s, : len(own)], count[s] = own, len(own)
    return table, near, count


def near_codewords(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the codewords within 4 bits, nearest first, padded with the nearest; how many)."""
    table, near, count = golay()
    s = table[0][word & 255] ^ table[1][word >> 8 & 255] ^ table[2][word >> 16 & 127]
    n = count[s]
    errors = np.where(np.arange(6)[None, :] < n[:, None], near[s], near[s][:, :1])
    return (word[:, None] ^ errors) >> CHECK, n


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its fingerprint): about 61 keys each."""
    seg = [((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    code = [near_codewords(s) for s in seg]
    keys, of = [], []

    def add(tag, left, right, keep):
        keys.append((np.int64(tag) << 50 | left << 24 | right)[keep])
        of.append(np.flatnonzero(keep))

    for tag, (p, q) in enumerate(((0, 1), (1, 2), (0, 2))):
        (cp, n_p), (cq, n_q) = code[p], code[q]
        for k in range(6):
            add(3 * tag, seg[p], cq[:, k].astype(np.int64), k < n_q)
            add(3 * tag + 1, seg[q], cp[:, k].astype(np.int64), k < n_p)
            add(3 * tag + 2, cp[:, 0].astype(np.int64), cq[:, k].astype(np.int64), k < n_q)
            if k:
                add(3 * tag + 2, cp[:, k].astype(np.int64), cq[:, 0].astype(np.int64), k < n_p)
    return np.concatenate(keys), np.concatenate(of)


def links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that connect what lies within DISTANCE under a common key.

    All pairs of a key's members are compared, small keys side by side; a large key is
    searched breadth first, frontier against what is not reached yet, in blocks. Only
    a forest is kept of the links found.
    """
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1]))
    keys, fps = keys[fresh], fps[fresh]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(head, append=len(keys))
    a, b = [], []
    left = np.repeat(size, size) - (np.arange(len(keys)) - np.repeat(head, size)) - 1  # members of the key after this one
    i = np.flatnonzero((left > 0) & (np.repeat(size, size) <= SMALL))
    for step in range(1, SMALL):
        i = i[left[i] >= step]
        if not len(i):
            break
        hit = np.bitwise_count(fps[i] ^ fps[i + step]) <= DISTANCE
        a.append(fps[i[hit]])
        b.append(fps[i[hit] + step])
    for g in np.flatnonzero(size > SMALL).tolist():
        rest = fps[head[g] : head[g] + size[g]]
        while len(rest):
            frontier, rest = rest[:1], rest[1:]
            while len(frontier) and len(rest):
                nxt = []
                for k in range(0, len(frontier), 512):
                    block = frontier[k : k + 512]
                    to = np.full(len(rest), -1, np.int64)
                    for at in range(0, len(rest), 8192):
                        near = np.bitwise_count(rest[None, at : at + 8192] ^ block[:, None]) <= DISTANCE
                        got = near.any(0)
                        to[at : at + 8192][got] = near[:, got].argmax(0)
                    got = to >= 0
                    a.append(block[to[got]])
                    b.append(rest[got])
                    nxt.append(rest[got])
                    rest = rest[~got]
                frontier = np.concatenate(nxt) if nxt else frontier[:0]
    if not a or not sum(map(len, a)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts in turn, how many each text has)."""
    import xxhash

    n, docs = len(buf), len(offs) - 1
    none = np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    if not n:
        return none
    low, blank = _LOWER[buf], _BLANK[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    after = np.append(True, blank[:-1]) | first[:n]
    start = np.flatnonzero(~blank & after)  # of words
    if not len(start):
        return none
    stop = np.flatnonzero(~blank & (np.append(blank[1:], True) | first[1:])) + 1
    # words of the batch joined by single spaces
    length = stop - start
    keep = ~blank
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
    at = np.cumsum(length + 1) - (length + 1)
    mask = np.ones(len(joined), bool)
    mask[at + length] = False
    joined[mask] = low[keep]
    per = np.diff(np.searchsorted(start, offs))
    word0 = np.cumsum(per) - per
    shingles = np.where(per == 0, 0, np.maximum(per - words + 1, 1))
    total = int(shingles.sum())
    base = np.cumsum(shingles) - shingles
    w = np.repeat(word0 - base, shingles) + np.arange(total)
    e = np.minimum(w + words - 1, np.repeat(word0 + per - 1, shingles))
    data, digest = joined.tobytes(), xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(data[i:j], SEED) for i, j in zip(at[w].tolist(), (at[e] + length[e]).tolist(), strict=True)]), "<u8")
    return h, shingles


def fingerprint_batch(buf: np.ndarray, offs: np.ndarray, words: int = 4) -> np.ndarray:
    """Fingerprints as big-endian rows of 8 bytes."""
    return fingerprint_of(*shingle_hashes(buf, offs, words))


def fingerprint_of(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The same of hashes, and of how many of them each text has."""
    docs = len(shingles)
    out = np.zeros((docs, 8), np.uint8)
    if not len(h):
        return out
    base = np.cumsum(shingles) - shingles
    # counts of each bit: bytes added eight at a time, in runs of at most 255 rows
    runs = -(-shingles // 255)
    run_doc = np.repeat(np.arange(docs), runs)
    run_at = base[run_doc] + 255 * (np.arange(len(run_doc)) - np.repeat(np.cumsum(runs) - runs, runs))
    ones, some = np.uint64(0x0101010101010101), np.flatnonzero(runs)
    head = (np.cumsum(runs) - runs)[some]
    bits = np.zeros((len(some), 8, 8), np.int64)
    for b in range(8):
        part = np.add.reduceat((h >> np.uint64(b)) & ones, run_at).view(np.uint8).reshape(-1, 8)
        bits[:, :, 7 - b] = np.add.reduceat(part.astype(np.int64), head, axis=0)
    out[some] = np.packbits(2 * bits > shingles[some][:, None, None], axis=2)[:, :, 0]
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp): the 64 bits as a long. Fewer words than a shingle make one shingle; no word gives 0."""
    def run(batches):
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            parts = [fingerprint_batch(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words) for i, j in slices(offs)]
            fp = np.concatenate(parts).reshape(-1).view(">i8").astype(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["key", "fp"])

    return df.select(key, text).mapInArrow(tidy(run), f"key {dict(df.dtypes)[key]}, fp long")


def _keyed(buckets: int):
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            keys, of = keys_of(fp)
            bucket = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            pairs = np.stack([keys[order], fp[of[order]].view(np.int64)], 1)
            used, head = np.unique(bucket[order], return_index=True)
            ends = np.append(head[1:], len(order))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pairs[i:j].tobytes() for i, j in zip(head, ends, strict=True)], pa.binary())], ["bucket", "pairs"])

    return run


def _linked(table: pa.Table) -> pa.Table:
    pairs = np.frombuffer(b"".join(x.as_buffer() for x in table.column("pairs")), np.int64).reshape(-1, 2)
    u, v = links_of(pairs[:, 0].copy(), pairs[:, 1].copy().view(np.uint64))
    del pairs
    release()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def reached(ws: Workspace, fps: DataFrame) -> DataFrame:
    """(u, v): v is the smallest fingerprint reachable from u over links of DISTANCE bits or fewer; but for the smallest ones."""
    n = fps.count()
    buckets = max(partitions(fps.sparkSession), -(-n * 61 // KEYS_PER_BUCKET))
    keyed = fps.select("fp").mapInArrow(tidy(_keyed(buckets)), "bucket int, pairs binary").repartition(buckets, "bucket")
    return components(ws, ws.save(keyed.groupBy("bucket").applyInArrow(_linked, "u long, v long"), "links"))


def link(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links of 4 bits or fewer.

    Documents with equal fingerprints are one node, so copies are never paired. The
    keys of all distinct fingerprints travel as packed arrays, one per task and
    bucket; the number of buckets follows the number of fingerprints. What a bucket
    returns is a forest, never all pairs. Null texts are empty and have fingerprint
    0, linked like any other; null keys take part but are never the smallest unless
    all are null; other columns are left out; an empty table gives no row. Members of a
    key meet in one task: those that are linked are reached at once from the first of
    them, and distinct fingerprints around one place are bounded by what four bits allow.
    """
    ws = Workspace(df.sparkSession, "simhash")
    rows = ws.save(fingerprints(df, key, text, words), "fingerprints")
    nodes = ws.save(rows.groupBy("fp").agg(F.min("key").alias("low")), "nodes")
    roots = reached(ws, nodes)
    named = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return ws.result(rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id"))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups by shingle similarity: (key, th, group, component_id), see `copies`.

    Fingerprints of `words` words that Golay keys link are candidates first. At 0.8, though, the
    fingerprints of two texts differ in 9.7 of 64 bits on average, and Golay codewords within reach
    of that many errors are too common to be keys; so least shingle hashes are keys of what 4 bits
    can't reach. All links are verified by the whole shingle sets.
    """
    from . import copies

    return copies.link(df, key, text, words, similarity)


def query(spark, sf_dir: str) -> DataFrame:
    out = link(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
