"""Operator 9: copies of images, cropped or edited, by local descriptors.

Corners are found on several scales: the places whose response is the largest within
RADIUS pixels, so their number follows an image's area and a crop keeps those of its part.
Each gets a main direction and a string of binary tests between points turned into that
direction. Two strings that share the bits of one of several tables' positions are
candidates; close ones are matches. Each match of a query's corner says where, how large
and how turned the query would lie in the image; matches that agree on it are the
geometric consensus.

Only keys that some query may have travel to the join: which ones is a bitmap of TABLES
times 2 ** SLOT_BITS bits (8 MB), whatever the number of images and queries.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, text_buffers, tidy

SCALES = (1.0, 1.5, 2.25)
RADIUS = 4  # pixels of the scale within which a corner is the strongest
TESTS = 256
TABLES, TABLE_BITS = 16, 48
SLOT_BITS = 22  # of a table's slots in the bitmap of the keys that queries have
DISTANCE = 40  # bits that matching descriptors may differ in
CONSENSUS = 4  # different corners of the query that must agree
PATCH = 7  # tests lie within this radius, in pixels of the scale
SEED = 9


@functools.cache
def _tests() -> tuple[np.ndarray, np.ndarray]:
    """(points of the tests as [test, end, xy], bit positions of each table)."""
    rng = np.random.default_rng(SEED)
    points = np.clip(rng.normal(0, PATCH / 2, (TESTS, 2, 2)), -PATCH, PATCH)
    return points, np.stack([rng.choice(TESTS, TABLE_BITS, replace=False) for _ in range(TABLES)])


def _smooth(x: np.ndarray) -> np.ndarray:
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (1, 1)
        p = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        cut = [np.take(p, np.arange(k, k + n), axis) for k in range(3)]
        x = (cut[0] + 2 * cut[1] + cut[2]) / 4
    return x


def _resized(images: np.ndarray, scale: float) -> np.ndarray:
    rows, columns = images.shape[1:]
    h, w = (max(1, int(round(n / scale))) for n in (rows, columns))
    y, x = (np.arange(h) + 0.5) * rows / h - 0.5, (np.arange(w) + 0.5) * columns / w - 0.5
    y, x = np.clip(y, 0, rows - 1), np.clip(x, 0, columns - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, columns - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    upper, lower = images[:, y0], images[:, y1]
    top = upper[:, :, x0] * (1 - fx) + upper[:, :, x1] * fx
    low = lower[:, :, x0] * (1 - fx) + lower[:, :, x1] * fx
    return top * (1 - fy) + low * fy


def _highest(r: np.ndarray, radius: int) -> np.ndarray:
    """The largest value within radius of each place, along both axes."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (radius, radius)
        p, n = np.pad(r, pad, constant_values=-np.inf), r.shape[axis]
        r = np.take(p, np.arange(n), axis)
        for k in range(1, 2 * radius + 1):
            r = np.maximum(r, np.take(p, np.arange(k, k + n), axis))
    return r


def _described(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`describe` of equally large images: (image of each corner, places, bits)."""
    points, _ = _tests()
    which, places, bits = [], [], []
    base = images.astype(np.float64)
    off = np.arange(-PATCH, PATCH + 1)
    yy, xx = np.meshgrid(off, off, indexing="ij")
    disk = (yy**2 + xx**2) <= PATCH * PATCH
    for scale in SCALES:
        x = _smooth(base if scale == 1 else _resized(_smooth(base), scale))
        h, w = x.shape[1:]
        if min(h, w) < 2 * PATCH + 3:
            continue
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[:, PATCH:-PATCH, PATCH:-PATCH]
        i, ys, xs = np.nonzero((inner >= _highest(inner, RADIUS)) & (inner > 1e-6))
        if not len(i):
            continue
        ys, xs = ys + PATCH, xs + PATCH
        patch = x[i[:, None], ys[:, None] + yy[disk], xs[:, None] + xx[disk]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * yy[disk]).sum(1), (patch * xx[disk]).sum(1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = points[None, :, :, 0] * cos - points[None, :, :, 1] * sin + xs[:, None, None]
        py = points[None, :, :, 0] * sin + points[None, :, :, 1] * cos + ys[:, None, None]
        v = x[i[:, None, None], np.clip(np.rint(py), 0, h - 1).astype(int), np.clip(np.rint(px), 0, w - 1).astype(int)]
        bits.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
        sx, sy = base.shape[2] / w, base.shape[1] / h
        places.append(np.stack([(xs + 0.5) * sx, (ys + 0.5) * sy, np.full(len(xs), scale), angle], 1))
        which.append(i)
    if not bits:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8)
    return np.concatenate(which), np.concatenate(places), np.concatenate(bits)


def describe(images: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image of each corner, corners as [x, y, scale, angle], their bits as [n, TESTS / 8] bytes) of grey images, in turn.

    Images that are None, empty, not of two dimensions or too small have no corner.
    """
    by: dict[tuple[int, ...], list[int]] = {}
    for k, image in enumerate(images):
        if image is not None and image.ndim == 2 and image.size:
            by.setdefault(image.shape, []).append(k)
    parts = [(np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8))]
    for (h, w), ks in by.items():
        step = max(1, (1 << 18) // (h * w))  # pixels at a time
        for n in range(0, len(ks), step):
            i, places, bits = _described(np.stack([images[k] for k in ks[n : n + step]]))
            parts.append((np.array(ks[n : n + step])[i], places, bits))
    i, places, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], places[order], bits[order]


GEOMETRY = ("x", "y", "scale", "angle")


def descriptors(df: DataFrame, render, key_type: str) -> DataFrame:
    """(id, corner, x, y, scale, angle, bits) of every image; render: Arrow batch -> images or None for rows without."""

    def run(batches):
        for batch in batches:
            for n in range(0, batch.num_rows, 256):
                part = batch.slice(n, 256)
                i, places, bits = describe(render(part))
                corner = np.arange(len(i)) - np.searchsorted(i, i)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TESTS // 8), len(i), [None, pa.py_buffer(np.ascontiguousarray(bits))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(corner.astype(np.int32)), *(pa.array(places[:, k].astype(np.float32)) for k in range(4)), rows], ["id", "corner", *GEOMETRY, "bits"])

    return df.mapInArrow(tidy(run), f"id {key_type}, corner int, x float, y float, scale float, angle float, bits binary")


def table_keys(bits: np.ndarray) -> np.ndarray:
    """[descriptor, table]: the bits at each table's positions, and the table's number above them."""
    flat = np.unpackbits(bits, axis=1)
    out = np.empty((len(bits), TABLES), np.int64)
    for t, positions in enumerate(_tests()[1]):
        out[:, t] = flat[:, positions] @ (1 << np.arange(TABLE_BITS, dtype=np.int64)) | t << TABLE_BITS
    return out


def slots(keys: np.ndarray) -> np.ndarray:
    """The place of each key in the bitmap; other keys of the table may share it."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)
    return keys >> TABLE_BITS << SLOT_BITS | mixed.astype(np.int64)


def _bits_of(column: pa.Array) -> np.ndarray:
    return text_buffers(column)[0].reshape(-1, TESTS // 8)


def _marked(batches):
    """The bits of the keys that a task's descriptors have, as (word, its bits)."""
    held = np.zeros((TABLES << SLOT_BITS) // 64, np.uint64)
    for batch in batches:
        at = slots(table_keys(_bits_of(batch.column(0)))).reshape(-1)
        np.bitwise_or.at(held, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    used = np.flatnonzero(held)
    for n in range(0, len(used), 10_000):
        part = used[n : n + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part].view(np.int64))], ["word", "bits"])


def _keyed(wanted):
    """The rows once for each of their keys that is wanted (a broadcast bitmap; None: all)."""

    def run(batches):
        for batch in batches:
            for n in range(0, batch.num_rows, 4096):
                part = batch.slice(n, 4096)
                keys = table_keys(_bits_of(part.column(part.schema.get_field_index("bits"))))
                ok = np.ones(keys.shape, bool)
                if wanted is not None:
                    at = slots(keys)
                    ok = (wanted.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
                row, table = np.nonzero(ok)
                found = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, table]), *found.columns], ["k", *found.schema.names])

    return run


def _matched(batches):
    """Verified matches and the placement that each votes for, of rows of (query corner, image corner)."""
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        if not batch.num_rows:
            continue
        ok = np.flatnonzero(np.bitwise_count(_bits_of(c["q_bits"]) ^ _bits_of(c["bits"])).sum(1) <= DISTANCE)
        v = {n: c[n].to_numpy(zero_copy_only=False)[ok].astype(np.float64) for n in (*GEOMETRY, *(f"q_{g}" for g in GEOMETRY))}
        turn = v["angle"] - v["q_angle"]
        size = np.log(v["scale"] / v["q_scale"]) / np.log(1.5)
        ratio = v["scale"] / v["q_scale"]
        left = v["x"] - ratio * (np.cos(turn) * v["q_x"] - np.sin(turn) * v["q_y"])
        top = v["y"] - ratio * (np.sin(turn) * v["q_x"] + np.cos(turn) * v["q_y"])
        # a bin and its lower neighbour each, so that agreeing matches share one whatever the grid
        turn_bin = np.rint(np.mod(turn, 2 * np.pi) / (np.pi / 8)).astype(np.int64) % 16
        shape, bx, by = [], [], []
        for dx in (0, 1):
            for dy in (0, 1):
                bx.append(np.floor(left / 8 + dx / 2).astype(np.int64))
                by.append(np.floor(top / 8 + dy / 2).astype(np.int64))
                shape.append(((np.rint(size).astype(np.int64) + 8) * 16 + turn_bin) * 4 + 2 * dx + dy)
        sub = batch.take(pa.array(np.tile(ok, 4)))
        yield pa.RecordBatch.from_arrays([*(sub.column(n) for n in ("query_id", "id", "q_corner")), *(pa.array(np.concatenate(x)) for x in (shape, bx, by)), pa.array(np.tile(left, 4)), pa.array(np.tile(top, 4))], ["query_id", "id", "q_corner", "shape", "bx", "by", "left", "top"])


def copies(index: DataFrame, queries: DataFrame, render, render_query, key_type: str = "long") -> DataFrame:
    """(query_id, id, consensus, left, top): indexed images that a query image is a copy or a part of.

    index, queries: a key and whatever render and render_query turn into grey images,
    distinct images only (see `search`). consensus is the number of the query's corners
    that agree on one placement, left and top where the query's origin lies in the image
    at the median. Descriptors meet by table keys in a shuffle join, whose frequent keys
    are split by the engine, and are verified by Hamming distance; no pair is formed
    without a common key, and no partner is dropped. Images that are null, empty or too
    small have no corner and match none; of equally good placements the larger one by
    its bin is told; an empty table gives no row. The result is a written table.
    """
    spark, ws = index.sparkSession, Workspace(index.sparkSession, "images")
    right = ws.save(descriptors(queries, render_query, key_type), "queries")
    words = right.select("bits").mapInArrow(tidy(_marked), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = np.zeros((TABLES << SLOT_BITS) // 64, np.uint64)  # whatever the number of queries
    found = words.toArrow()
    held[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    wanted = spark.sparkContext.broadcast(held)
    left = ws.save(descriptors(index, render, key_type).mapInArrow(tidy(_keyed(wanted)), f"k long, id {key_type}, corner int, x float, y float, scale float, angle float, bits binary"), "index")
    asked = ws.save(right.mapInArrow(tidy(_keyed(None)), left.schema), "asked")
    asked = asked.select("k", F.col("id").alias("query_id"), F.col("corner").alias("q_corner"), *(F.col(c).alias(f"q_{c}") for c in (*GEOMETRY, "bits")))
    pairs = left.join(asked, "k").drop("k", "corner")
    votes = pairs.mapInArrow(tidy(_matched), f"query_id {key_type}, id {key_type}, q_corner int, shape long, bx long, by long, left double, top double")
    at = ["query_id", "id", "shape", "bx", "by"]
    # two corners may meet under several keys and vote the same each time
    won = votes.groupBy(*at, "q_corner").agg(F.avg("left").alias("left"), F.avg("top").alias("top"))
    won = won.groupBy(*at).agg(F.count("*").alias("consensus"), F.avg("left").alias("left"), F.avg("top").alias("top")).where(F.col("consensus") >= CONSENSUS)
    best = F.max_by(F.struct("consensus", "left", "top"), F.struct("consensus", "shape", "bx", "by"))
    out = ws.result(won.groupBy("query_id", "id").agg(best.alias("b")).select("query_id", "id", "b.consensus", "b.left", "b.top"))
    wanted.destroy()
    return out


def pictures(vectors: list, side: int = 64) -> list[np.ndarray | None]:
    """Grey images for vectors: a texture drawn with the vector's bytes as seed. None for those that hold nothing finite.

    Equal vectors have equal pictures and different ones unrelated pictures, so that what
    is found are copies and not likenesses.
    """
    import xxhash

    out: list[np.ndarray | None] = [None] * len(vectors)
    rows = [np.asarray([np.nan if x is None else x for x in v], np.float64) if v is not None else np.zeros(0) for v in vectors]
    some = [k for k, v in enumerate(rows) if len(v) and np.isfinite(v).all() and np.any(v)]
    for n in range(0, len(some), 64):
        ks = some[n : n + 64]
        draws = [np.random.default_rng(xxhash.xxh64_intdigest(rows[k].tobytes(), SEED)) for k in ks]
        fine = _smooth(_smooth(_smooth(np.stack([d.standard_normal((side, side)) for d in draws]))))
        coarse = _resized(np.stack([d.standard_normal((side // 8, side // 8)) for d in draws]), 1 / 8)
        shown = fine / fine.std((1, 2), keepdims=True) + coarse
        low, high = shown.min((1, 2), keepdims=True), shown.max((1, 2), keepdims=True)
        for k, x in zip(ks, np.rint((shown - low) / (high - low) * 255), strict=True):
            out[k] = x
    return out


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A crop of three quarters, brightened, with a little noise, for one seed in three turned by a quarter."""
    rng = np.random.default_rng(seed)
    side = image.shape[0] * 3 // 4
    y, x = rng.integers(0, image.shape[0] - side + 1, 2)
    out = image[y : y + side, x : x + side] * rng.uniform(0.7, 1.1) + rng.uniform(0, 25) + rng.normal(0, 2, (side, side))
    return np.rot90(out) if seed % 3 == 0 else out


def search(df: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, image_id, n_rows, consensus, left, top) for the rows whose key is divisible by `every`.

    The tables hold no images, so each row's vector is shown as one of its own (see `pictures`); the
    query of a row is an edited copy of its image. Rows with equal vectors are one image
    under their smallest key, n_rows says how many, so equal rows are never paired.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    images = rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n")
    asked = rows.where(F.col("id") % every == 0)

    def shown(batch):
        return pictures(batch.column(1).to_pylist())

    def asked_for(batch):
        found = zip(batch.column(0).to_pylist(), shown(batch), strict=True)
        return [None if p is None else edited(p, abs(i)) for i, p in found]

    out = copies(images.select("id", "v"), asked, shown, asked_for)
    return out.join(images.select("id", "n"), "id").select("query_id", F.col("id").alias("image_id"), F.col("n").alias("n_rows"), "consensus", F.round("left", 3).alias("left"), F.round("top", 3).alias("top"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))
