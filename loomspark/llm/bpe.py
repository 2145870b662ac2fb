"""Operator 10: byte-level BPE encoding and decoding over whole Arrow batches.

Pretokens are located by class arrays (see `pretokens`), each distinct one is
merged once and kept, and every id keeps its byte offset for decoding.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import TextEncoder
from .store import slices, text_buffers, tidy


LONG = 256  # bytes of the longest word that is merged together with others


class Merger:
    """Pair merging for many words at once: each round joins every word's lowest-ranked pair, leftmost first.

    Long words go one by one, as they would need a round for each of their pairs.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        self.size, self.none = size, size
        self.bits = max(16, (4 * len(pairs)).bit_length())
        self.keys, self.vals = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        todo, val = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot, self.probes = self._slot(todo), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = todo[free]
            won = self.keys[slot] == todo
            self.vals[slot[won]] = val[won]
            todo, val, slot = todo[~won], val[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left, right):
        key = left * self.size + right
        slot, out = self._slot(key), np.full(len(key), self.none, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            have = self.keys[slot]
            hit = have == key[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            more = ~hit & (have >= 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has)."""
        if max(map(len, words), default=0) <= LONG:
            return self._together(words)
        ids, counts = self._together([w for w in words if len(w) <= LONG])
        short = iter(np.split(ids, np.cumsum(counts)))
        found = [next(short) if len(w) <= LONG else self._alone(w) for w in words]
        return np.concatenate(found).astype(np.int32), np.fromiter(map(len, found), np.int32, len(found))

    def _alone(self, word: bytes) -> np.ndarray:
        """One long word, its pairs in a heap by rank and place: n log n steps."""
        sym = self.byte[np.frombuffer(word, np.uint8)]
        ranks = self._rank(sym[:-1], sym[1:])
        sym, n = sym.tolist(), len(sym)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < self.none]
        heapq.heapify(heap)
        current = ranks.tolist() + [self.none]

        def renew(i):
            j = ahead[i]
            r = self._one(sym[i], sym[j]) if j < n else self.none
            current[i] = r
            if r < self.none:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if sym[i] < 0 or current[i] != r:
                continue
            j = ahead[i]
            sym[i], sym[j], ahead[i] = r, -1, ahead[j]
            if ahead[j] < n:
                behind[ahead[j]] = i
            renew(i)
            if behind[i] >= 0:
                renew(behind[i])
        return np.array([x for x in sym if x >= 0], np.int64)

    def _one(self, left: int, right: int) -> int:
        key, mask = left * self.size + right, (1 << self.bits) - 1
        slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while (have := int(self.keys[slot])) >= 0:
            if have == key:
                return int(self.vals[slot])
            slot = (slot + 1) & mask
        return self.none

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        parts, done = [], []
        rank = np.full(len(sym), self.none, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, head)
            span = np.diff(head, append=len(sym))
            live = low < self.none
            on = np.repeat(live, span)
            parts.append(sym[~on])
            done.append(word[~on])
            sym, word, rank, low, span = sym[on], word[on], rank[on], low[live], span[live]
            if not len(sym):
                break
            head = np.cumsum(span) - span
            best = np.flatnonzero(rank == np.repeat(low, span))
            best = best[np.unique(word[best], return_index=True)[1]]  # leftmost of each word
            sym[best] = low
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, best = sym[keep], word[keep], rank[keep], place[best]
            for side in (best - 1, best):
                ok = side[(side >= 0) & (side + 1 < len(sym))]
                same = word[ok] == word[ok + 1]
                rank[ok[same]] = self._rank(sym[ok[same]], sym[ok[same] + 1])
            tail = best[(best + 1 >= len(sym)) | (word[np.minimum(best + 1, len(sym) - 1)] != word[best])]
            rank[tail] = self.none
        ids, of = np.concatenate(parts), np.concatenate(done)
        ids = ids[np.argsort(of, kind="stable")]
        return ids.astype(np.int32), np.bincount(of, minlength=len(words)).astype(np.int32)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encode texts to ids and back. The byte offset of every id follows from the tokens' lengths."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.encode_texts = TextEncoder(Merger(ranks))
        top = max(ranks.values()) + 1
        by = [b""] * top
        for token, rank in ranks.items():
            by[rank] = token
        self.length = np.fromiter(map(len, by), np.int64, top)
        self.pool, self.at = np.frombuffer(b"".join(by), np.uint8), np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, the byte offset of each id and the end)."""
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        data = self.pool[np.repeat(self.at[ids] - (ends - n), n) + np.arange(total)]
        return data, np.concatenate([[0], ends])


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


@functools.cache
def _digits(top: int):
    """Decimal digits of each id and a space, left-aligned, and how many bytes that is."""
    text = np.array([f"{i} " for i in range(top)], "S8").view(np.uint8).reshape(top, 8)
    return text, text != 0, (text != 0).sum(1)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ``ids`` (array<int>) and ``byte_offsets`` (array<int>, one more than ids).

    path: a file of base64 tokens and ranks that every executor has. Null text is the
    empty text and has no ids; all other columns stay; rows stay where they are.
    """
    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema.fields if f.name not in ("ids", "byte_offsets")] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("byte_offsets", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields[:-2]]

    def run(batches):
        c = codec(path)
        for batch in batches:
            buf, offs = text_buffers(batch.column(text))
            for i, j in slices(offs):
                ids, ends = c.encode_texts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                per, starts = [], []
                where = np.concatenate([[0], np.cumsum(c.length[ids])])
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    per.append(ids[a:b])
                    starts.append((where[a : b + 1] - where[a]).astype(np.int32))
                part = batch.slice(i, j - i)
                cols = [part.column(x) for x in names] + [pa.array(per, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, [*names, "ids", "byte_offsets"])

    return df.select(*{*names, text}).select(*dict.fromkeys([*names, text])).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary): the bytes of its ids. Null ids give empty bytes."""
    from pyspark.sql import types as T

    names = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([f for f in df.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            col = batch.column(ids)
            out = [c.decode(np.asarray(x.values if x.is_valid else [], np.int64))[0].tobytes() for x in col]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(out, pa.binary())], [*names, "decoded"])

    return df.select(*names).mapInArrow(tidy(run), schema)


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and return only counts and digests: (key, n_tokens, ids_sha256, decoded_sha256, offsets_crc32).

    The same codec as `encode` and `decode`, without carrying the ids out of the task.
    offsets_crc32 is that of the ids' byte offsets, as `encode` has them, in
    little-endian unsigned 32-bit integers. A null text is empty; rows stay as they
    are, repeated ones too; other columns are left out.
    """
    def run(batches):
        c = codec(path)
        text_of, mask_of, len_of = _digits(len(c.length))
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            count, h1, h2, crc = [], [], [], []
            for i, j in slices(offs):
                ids, ends = c.encode_texts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                data, where = c.decode(ids)
                shown = text_of[ids][mask_of[ids]]
                at = np.concatenate([[0], np.cumsum(len_of[ids])])
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    count.append(b - a)
                    h1.append(hashlib.sha256(shown[at[a] : max(at[a], at[b] - 1)]).hexdigest())
                    h2.append(hashlib.sha256(data[where[a] : where[b]]).hexdigest())
                    crc.append(zlib.crc32((where[a : b + 1] - where[a]).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(h1, pa.string()), pa.array(h2, pa.string()), pa.array(crc, pa.int64())], [key, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"])

    return df.select(key, text).mapInArrow(tidy(run), f"{key} {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
