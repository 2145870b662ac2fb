"""Operator 1: token ids in compressed binary segments.

Ids are counted over the whole corpus, given a canonical Huffman code whose
lengths are limited (package-merge), and written in ascending key order. A
segment is one binary image in a Parquet row, so Spark's commit protocol covers
task retries and any store that Spark reads can hold it:

    magic "LHF1" | 5 little-endian u32: longest code, ids, ids per block, code table bytes, index bytes
    code table: zlib of one length byte per id (0: no code)
    index: Arrow IPC batch, zstd: key, n_tokens of each document
    bit offset (u64) of every block of ids_per_block ids
    the bits, most significant first, and 8 bytes of padding

Blocks need nothing but their own offset, so all blocks of a segment are decoded
in step, one table look-up per id.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import library_encoder
from .store import Workspace, bases, partitions, slices, text_buffers, tidy

MAGIC = b"LHF1"
BLOCK = 256
SEGMENT = 1 << 20  # ids, at least one document


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if 1 << limit < len(used):
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    level, is_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < len(leaf))
    length, take = np.zeros(len(leaf), np.int64), 2 * len(leaf) - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: numbered by (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - before
        before = n
        ids = np.flatnonzero(lengths == n)
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bit offset of every block)."""
    size = lengths[ids].astype(np.int64)
    if len(ids) and not size.all():
        raise ValueError("an id has no code")
    ends = np.cumsum(size)
    at = ends - size
    if not len(ids):
        return np.zeros(8, np.uint8), np.zeros(0, np.int64)
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    joined = np.bitwise_or.reduceat(value, head)  # codes are shorter than a word, so no word is skipped
    out = np.zeros(int(word[-1]) + 2, np.uint32)
    out[word[head]] = joined >> np.uint64(32)
    out[word[head] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.concatenate([out.astype(">u4").view(np.uint8), np.zeros(8, np.uint8)]), at[::BLOCK]


@functools.lru_cache(4)
def _tables(table: bytes, limit: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(zlib.decompress(table), np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    n = lengths[order].astype(np.int64)
    span = np.int64(1) << (limit - n)
    symbol, size = np.zeros(1 << limit, np.int32), np.ones(1 << limit, np.uint8)
    total = int(span.sum())
    symbol[:total], size[:total] = np.repeat(order, span), np.repeat(n, span)
    return symbol, size


def unpack(bits: np.ndarray, offsets: np.ndarray, count: int, block: int, table: bytes, limit: int) -> np.ndarray:
    """All ids; the blocks advance together, one id each per step."""
    symbol, size = _tables(table, limit)
    view = np.ndarray((len(bits) - 7,), ">u8", bits, strides=(1,))
    at, lanes = offsets.astype(np.int64).copy(), len(offsets)
    out = np.zeros((min(block, count), lanes), np.int32)
    last = len(view) - 1
    for k in range(out.shape[0]):
        w = view[np.minimum(at >> 3, last)].astype(np.uint64)
        i = ((w << (at & 7).astype(np.uint64)) >> np.uint64(64 - limit)).astype(np.int64)
        out[k] = symbol[i]
        at += size[i]
    return out.T.reshape(-1)[:count] if lanes > 1 else out[:count, 0] if lanes else np.zeros(0, np.int32)


def write_segment(keys: pa.Array, n_tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, limit: int, table: bytes) -> bytes:
    bits, offsets = pack(ids, lengths, codes)
    batch = pa.RecordBatch.from_arrays([keys, pa.array(n_tokens, pa.int64())], ["key", "n_tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    index = sink.getvalue().to_pybytes()
    return b"".join([MAGIC, struct.pack("<5I", limit, len(ids), BLOCK, len(table), len(index)), table, index, offsets.astype("<u8").tobytes(), bits.tobytes()])


def read_segment(image: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(keys, n_tokens of each document, all ids)."""
    if image[:4] != MAGIC:
        raise ValueError("not a segment")
    limit, count, block, n_table, n_index = struct.unpack_from("<5I", image, 4)
    at = 24
    table, index = image[at : at + n_table], image[at + n_table : at + n_table + n_index]
    at += n_table + n_index
    blocks = -(-count // block)
    offsets = np.frombuffer(image, "<u8", blocks, at)
    bits = np.frombuffer(image, np.uint8, offset=at + 8 * blocks)
    batch = pa.ipc.open_stream(index).read_all().combine_chunks()
    n = batch.column(1).to_numpy()
    keys = batch.column(0)
    return (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys), n, unpack(bits, offsets, count, block, table, limit)


def tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens, ids): ids as little-endian u32 or, for small vocabularies, u16, with the end id."""
    width = id_type(path)
    names = [key, *keep]
    of = dict(df.dtypes)

    def run(batches):
        encode = library_encoder(path)
        for batch in batches:
            buf, offs = text_buffers(batch.column(len(names)))
            for i, j in slices(offs):
                ids, ends = encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if end is not None:
                    ids = np.insert(ids, ends[1:], end)
                    ends = ends + np.arange(len(ends))
                data = pa.py_buffer(ids.astype(width).tobytes())
                step = np.dtype(width).itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((ends * step).astype(np.int64).tobytes()), data])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(np.diff(ends), pa.int64()), blobs.cast(pa.binary())], [*names, "n_tokens", "ids"])

    return df.select(*names, text).mapInArrow(tidy(run), ", ".join(f"`{c}` {of[c]}" for c in names) + ", n_tokens long, ids binary")


@functools.cache
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def id_type(path: str) -> str:
    return "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 2, out: str | None = None) -> DataFrame:
    """Write df's texts as compressed segments in ascending key order; returns the segments, reread.

    Columns: _part, start (ids before the segment within its part), n_tokens, image.
    A null text is empty and holds the end id only; null keys come first; rows with
    equal keys all stay, ordered by a hash of their ids; other columns are left out; an empty
    table gives no segment. The code book is bounded by the vocabulary; nothing else
    that is collected grows with the rows but a count per partition.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "tokenfiles")
    width, size = id_type(path), vocabulary_size(path)
    limit = max(16, size.bit_length() + 2)
    rows = ws.save(tokens(df, path, key, text, end), "ids")

    def histogram(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            buf, _ = text_buffers(batch.column(0))
            total += np.bincount(buf.view(width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for i, n in rows.select("ids").mapInArrow(tidy(histogram), "id int, n long").groupBy("id").agg(F.sum("n")).collect():  # at most one row per id of the vocabulary
        counts[i] = n
    lengths = code_lengths(counts, limit)
    table = zlib.compress(lengths.tobytes())

    def pack_rows(batches):
        from pyspark import TaskContext

        part, codes, start = TaskContext.get().partitionId(), canonical(lengths), 0
        held, held_n = [], 0

        def image():
            nonlocal start
            batch = pa.Table.from_batches(held).combine_chunks()
            ids = text_buffers(batch.column(2))[0].view(width).astype(np.int64)
            n = batch.column(1).to_numpy()
            out = write_segment(batch.column(0).combine_chunks(), n, ids, lengths, codes, limit, table)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([out], pa.binary())], ["_part", "start", "n_tokens", "image"])
            start += len(ids)
            return row

        for batch in batches:
            n, i = batch.column(1).to_numpy(), 0
            ends = np.cumsum(n)
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SEGMENT - held_n, "right")))
                held.append(batch.slice(i, j - i))
                held_n += int(n[i:j].sum())
                i = j
                if held_n >= SEGMENT or i < len(n):
                    yield image()
                    held, held_n = [], 0
        if held:
            yield image()

    # equal keys are ordered by a hash of their ids: sort keys are sampled on the driver, so they stay narrow
    ordered = rows.withColumn("h", F.xxhash64("ids")).repartitionByRange(partitions(spark), key, "h").sortWithinPartitions(key, "h").drop("h")
    packed = ordered.mapInArrow(tidy(pack_rows), "_part int, start long, n_tokens long, image binary")
    if out is not None:
        packed.write.option("compression", "none").parquet(out)
        packed = spark.read.schema(packed.schema).parquet(out)
    else:
        packed = ws.save(packed, "segments")
    ws.drop("ids")
    return packed


def read(segments: DataFrame, key_type: str = "long") -> DataFrame:
    """(key, start, n_tokens, ids array<int>) of every document of the segments."""
    return _decoded(segments, key_type, False)


def digest(segments: DataFrame, key_type: str = "long") -> DataFrame:
    """As read, with ids_crc32, the unsigned crc32 of the ids as little-endian u32, in place of ids."""
    return _decoded(segments, key_type, True)


def _decoded(segments: DataFrame, key_type: str, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, start, image in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                keys, n, ids = read_segment(image.as_buffer().to_pybytes())
                ends = np.concatenate([[0], np.cumsum(n)])
                if digest:
                    data = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(n), pa.int32()), keys, pa.array(ends[:-1] + start.as_py(), pa.int64()), pa.array(n, pa.int64()), last], ["_part", "key", "at", "n_tokens", "last"])

    rows = segments.select("_part", "start", "image").mapInArrow(tidy(run), f"_part int, key {key_type}, at long, n_tokens long, last {'long' if digest else 'array<int>'}")
    base = bases(segments, {"_n": F.col("n_tokens")})
    return rows.join(F.broadcast(base), "_part").select("key", (F.col("at") + F.col("_base_n")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    segments = write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(segments).withColumnRenamed("key", "doc_id")
