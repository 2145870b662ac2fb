"""Operator 8: mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import library_encoder
from .store import Workspace, numbered, slices, text_buffers, tidy

WINDOW = 1024
QUANTUM = 512  # ids that a source's turn gives, of one document as long as it has them; windows are a whole number of turns
SEED = 42
FEW = 50_000  # sources whose numbers are broadcast (5 MB)


def units(df: DataFrame, path: str, key: str, text: str, source: str, end: int, quantum: int) -> DataFrame:
    """One row per document: its ids cut in whole quanta (crc32 of each) and a rest, whose ids are kept."""
    of = dict(df.dtypes)

    def run(batches):
        encode = library_encoder(path)
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for i, j in slices(offs):
                ids, ends = encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = np.insert(ids, ends[1:], end).astype("<u4")
                ends = ends + np.arange(len(ends))
                data, sums, rest = memoryview(ids.tobytes()), [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    whole = a + (b - a) // quantum * quantum
                    sums.append([zlib.crc32(data[4 * p : 4 * (p + quantum)]) for p in range(a, whole, quantum)])
                    rest.append(bytes(data[4 * whole : 4 * b]))
                part, n = batch.slice(i, j - i), np.diff(ends)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(n // quantum, pa.int64()), pa.array(n % quantum, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(rest, pa.binary())], ["key", "source", "doc_tokens", "whole", "rest", "sums", "rest_ids"])

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), f"key {of[key]}, source string, doc_tokens long, whole long, rest long, sums array<long>, rest_ids binary")


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", end: int = 0, window: int = WINDOW, quantum: int = QUANTUM, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Each source has two queues, of whole quanta and of the quanta made of its
    documents' rests. With every window a queue's deficit grows by its share of the
    window and falls by a quantum when it is served; turn k of a queue of weight w
    and quantum q is therefore due when q (k + 1/2) / w of the windows have passed,
    so the order of all turns is a sort by due time, and deficits carry over windows
    and partitions by the turns' global numbers. A turn is long enough to leave a document
    in one piece for a while, so a single window holds a few sources only; it is the
    deficits that keep any number of windows from the first on within a turn or two of
    every source's share. weights: the sources' shares, their
    own token counts by default, which empty all queues at once. The ends of the rest
    queues, less than a quantum each, follow last; only the last sequence is short.

    A null text is empty and has the end id only; a null source is the source ''; rows
    with equal keys are packed one by one; other columns are left out; an empty table
    gives no piece. No queue is gathered in one task. The result is a written table, and
    what led to it is deleted.
    """
    if window % quantum:
        raise ValueError("a window must be a whole number of quanta")
    spark, ws, turns = df.sparkSession, Workspace(df.sparkSession, "packing"), window // quantum
    docs = ws.save(units(df, path, key, text, source, end, quantum), "units")
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), F.col("key").cast("string"), "rest_ids", F.col("sums").cast("string")))
    docs = numbered(ws, docs, ["source", "h", "key"], "queued", ("whole", "rest"))
    sums = docs.groupBy("source").agg(F.min("before_whole").alias("w0"), F.min("before_rest").alias("r0"), F.sum("whole").alias("w_n"), F.sum("rest").alias("r_n"))
    sums = numbered(ws, sums.withColumn("tail", F.col("r_n") % quantum).withColumn("turns", F.expr(f"w_n + r_n div {quantum}")), ["source"], "sources", ("tail", "turns"))
    if weights is None:
        weight = (F.col("w_n") * quantum + F.col("r_n")).cast("double")
    else:
        weight = F.coalesce(*(F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()), F.lit(1.0))
    sums = sums.withColumn("weight", weight).withColumnRenamed("pos", "source_no")
    n_turns = sums.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    of = sums.select("source", "source_no", "w0", "r0", "w_n", "r_n", "weight", "before_tail")
    # a source may hold most rows, so documents aren't dealt out by source while the sources are few enough to broadcast
    docs = docs.drop("pos").join(F.broadcast(of) if sums.count() <= FEW else of, "source")
    # a queue's share of its source's weight is its share of the source's ids
    due = (F.col("k") + 0.5) * (F.col("queue_n") + F.lit(0.0)) ** -1 * ((F.col("w_n") * quantum + F.col("r_n")) / F.col("weight"))
    whole = docs.where("whole > 0").select("key", "doc_tokens", "source_no", "weight", "w_n", "r_n", (F.col("before_whole") - F.col("w0")).alias("first"), F.posexplode("sums").alias("j", "ids_crc32"))
    whole = whole.select("key", (F.col("j") * quantum).cast("long").alias("start"), F.lit(quantum).cast("long").alias("length"), "ids_crc32", "doc_tokens", "source_no", F.lit(0).alias("queue"), (F.col("first") + F.col("j")).alias("k"), F.col("w_n").alias("queue_n"), "weight", "w_n", "r_n")

    schema = docs.select("key").schema[0].dataType.simpleString()

    def cut(batches):
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "source_no", "k", "at", "tail_at"]
        for batch in batches:
            c = batch.to_pydict()
            out = {n: [] for n in names}
            for key_, n, rest, ids, no, at, r_n, tail in zip(*(c[x] for x in ("key", "doc_tokens", "rest", "rest_ids", "source_no", "at", "r_n", "before_tail")), strict=True):
                full, p = r_n // quantum * quantum, 0
                while p < rest:
                    where = at + p
                    if where < full:
                        size, k, off, tail_at = min(rest - p, quantum - where % quantum), where // quantum, where % quantum, None
                    else:
                        tail_at = n_turns * quantum + tail + where - full
                        size, k, off = min(rest - p, window - tail_at % window), None, None
                    for name, value in zip(names, (key_, n - rest + p, size, zlib.crc32(ids[4 * p : 4 * (p + size)]), n, no, k, off, tail_at), strict=True):
                        out[name].append(value)
                    p += size
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], batch.schema.field("key").type), *(pa.array(out[x], pa.int64()) for x in names[1:])], names)

    rest = docs.where("rest > 0").select("key", "doc_tokens", "rest", "rest_ids", "source_no", (F.col("before_rest") - F.col("r0")).alias("at"), "r_n", "before_tail")
    rest = ws.save(rest.mapInArrow(tidy(cut), f"key {schema}, start long, length long, ids_crc32 long, doc_tokens long, source_no long, k long, at long, tail_at long"), "rests")
    heads = rest.where("at = 0").select("source_no", "k").join(sums.select("source_no", F.expr(f"r_n div {quantum}").alias("queue_n"), "weight", "w_n", "r_n"), "source_no")
    heads = heads.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema[:5]), "source_no", F.lit(1).alias("queue"), "k", "queue_n", "weight", "w_n", "r_n")
    order = numbered(ws, whole.unionByName(heads).withColumn("due", due).drop("queue_n", "weight", "w_n", "r_n"), ["due", "source_no", "queue", "k"], "turns")
    place = (F.floor(F.col("pos") / turns).alias("sequence_id"), ((F.col("pos") % turns) * quantum).alias("offset"))
    cols = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    a = order.where("queue = 0").select(*cols[:5], *place)
    b = rest.where("tail_at is null").join(order.where("queue = 1").select("source_no", "k", "pos"), ["source_no", "k"]).select(*cols[:5], place[0], (F.expr(f"(pos % {turns}) * {quantum}") + F.col("at")).alias("offset"))
    c = rest.where("tail_at is not null").select(*cols[:5], F.floor(F.col("tail_at") / window).alias("sequence_id"), (F.col("tail_at") % window).alias("offset"))
    return ws.result(a.unionByName(b).unionByName(c)).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), public_tokenizers.path("byte_bpe_50k.json"))
