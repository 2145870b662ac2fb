"""Near copies by the similarity of their shingle sets: Golay keys of fingerprints, least hashes as keys, exact verification.

Texts whose fingerprints Golay keys connect (see `simhash`) are held against the first text of
their component. What differs in more than four bits is met by other keys.

A text's set are the hashes of its shingles of `words` words. Under one random order of
all hashes, two texts have the same least one with the probability of their Jaccard
similarity. A key is that of some orders together (rows), and a text has some keys (bands), so a
pair of similarity s meets with probability 1 - (1 - s^rows)^bands. Both follow from the
similarity asked for (see `bands_for`): all but MISS of the pairs at it meet, and more above it.
Pairs that meet are verified by their whole sets, so no link is wrong. Texts are told by 128 bits
of hash and numbered; the numbers are what the tables hold.

Pairs are never rows. First every text is held against one text of each of its keys,
another one in each, which connects most of a group. Texts that are still apart from their
key's first text are held against all others of the key in blocks: a task takes two blocks
of at most BLOCK texts, counts what their sets share by a matrix product, and returns one
link at most for each text and component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import fingerprint_of, reached, shingle_hashes
from .store import Workspace, partitions, slices, text_buffers, tidy

MISS = 1.5e-5  # of the pairs that are just similar enough
MOST_BANDS = 28  # of a text, where keys of one order don't need more
SEED = 42
WORDS, SIMILARITY = 5, 0.8
BLOCK = 256  # texts of a block


def bands_for(similarity: float) -> tuple[int, int]:
    """(rows, bands): the most rows for which MOST_BANDS bands miss no more than MISS of the pairs; one, if there are none."""
    bands = lambda rows: math.ceil(math.log(MISS) / math.log1p(-(min(similarity, 1 - 1e-9) ** rows)))
    rows = max((r for r in range(1, 65) if bands(r) <= MOST_BANDS), default=1)
    return rows, bands(rows)


def keys_batch(buf: np.ndarray, offs: np.ndarray, words: int, rows: int, bands: int) -> np.ndarray:
    """[text, band]: the keys; texts without a word share theirs."""
    return keys_of(*shingle_hashes(buf, offs, words), rows, bands)


def keys_of(h: np.ndarray, count: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The same of hashes, and of how many of them each text has."""
    rng = np.random.default_rng(SEED)
    flip, odd = (rng.integers(0, 1 << 64, rows * bands, np.uint64) for _ in range(2))
    out = np.zeros((len(count), bands), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        head = (np.cumsum(count) - count)[some]
        for k, (a, b) in enumerate(zip(flip, odd | np.uint64(1), strict=True)):
            least = np.minimum.reduceat((h ^ a) * b, head)
            out[some, k // rows] = (out[some, k // rows] ^ least) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) + np.arange(bands, dtype=np.uint64)


def _sets(column, words: int) -> list[np.ndarray]:
    buf, offs = text_buffers(column)
    out = []
    for i, j in slices(offs):
        h, count = shingle_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
        out += [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def block_links(a: list[np.ndarray], b: list[np.ndarray], a_root: np.ndarray, b_root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a link of a[i] with each component of b's that is another one and has a set at least as similar."""
    na, nb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    apart = a_root[:, None] != b_root[None, :]
    if not apart.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # tokens of both sides by number
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    row_a, row_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    shared = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for flat, row in ((flat_a, row_a), (flat_b, row_b)):
        at = np.searchsorted(both, flat)
        own = np.flatnonzero((at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat)) if len(both) else np.zeros(0, np.int64)
        order = own[np.argsort(at[own], kind="stable")]
        sides.append((at[order], row[order]))
    for c in range(0, len(both), 4096):
        parts = []
        for (at, row), n in zip(sides, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(at, [c, c + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[row[i:j], at[i:j] - c] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    whole = na[:, None] + nb[None, :] - shared
    close = (shared >= similarity * whole - 1e-6) & apart
    i, j = np.nonzero(close)
    _, first = np.unique(np.stack([i, b_root[j]]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
    return i[first], j[first]


def _blocks_compared(similarity: float):
    def side(column):
        flat = column.flatten()  # struct of node, root, set
        node, root, sets = (flat.field(k) for k in range(3))
        ends = np.concatenate([[0], np.cumsum(np.fromiter((len(x) for x in sets), np.int64, len(sets)))])
        values = sets.flatten().to_numpy()
        return node.to_numpy(), root.to_numpy(), [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (x, x_root, a), (y, y_root, b) = (side(batch.column(k).slice(r, 1)) for k in range(2))
                i, j = block_links(a, b, x_root, y_root, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(y[j])], ["u", "v"])

    return run


def link(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, th, group, component_id): th is a hash of the text, component_id the smallest key reachable over pairs of at least
    `similarity`, group a number of the component, which tells components apart where keys repeat or are null.

    Equal texts are one node. Words are lower-cased and parted by white space; texts of
    fewer words than a shingle are one shingle; null texts are empty, and texts without a
    word are each other's copies. Null keys take part but are never the smallest unless
    all are null; other columns are left out; an empty table gives no row.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "copies")
    stars = [Workspace(spark, f"copies-{n}") for n in ("star", "rest", "golay")]
    own = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("th2"), F.col(text).alias("text"))
    per_key, bands = bands_for(similarity)

    def sketch(batches):
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            parts, fps = [], [np.zeros((0, 8), np.uint8)]
            for i, j in slices(offs):
                hashed = shingle_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)
                parts.append(keys_of(*hashed, per_key, bands))
                fps.append(fingerprint_of(*hashed))
            keys = np.concatenate(parts).view(np.int64) if parts else np.zeros((0, bands), np.int64)
            fp = np.concatenate(fps).reshape(-1).view(">i8").astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), lists], ["th", "th2", "fp", "ks"])

    def placed(rows, roots, *columns):
        for c in columns:
            rows = rows.join(roots.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
        return rows

    nodes = own.select("th", "th2", "text").mapInArrow(tidy(sketch), "th long, th2 long, fp long, ks array<long>").dropDuplicates(["th", "th2"])
    nodes = ws.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    most = bands * nodes.count()  # of keys, which bounds the tables of members
    keyed = nodes.select("node", F.explode("ks").alias("k"))
    # the text of a key that the others are held against first: another one in each key
    wide = keyed.groupBy("k").agg(F.min(F.struct(F.xxhash64("k", "node").alias("h"), "node"))["node"].alias("rep"), F.count("*").alias("c")).where("c > 1")
    members = ws.save(keyed.join(wide, "k"), "members")
    # texts of fingerprints that Golay keys connect, with the first text of each component
    connected = placed(nodes.select("node", "fp"), reached(stars[2], nodes.select("fp").distinct()), "fp")
    first = connected.groupBy("fp_root").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1")
    near = ws.save(connected.join(first, "fp_root").where("node <> b").select(F.col("node").alias("a"), "b"), "golay", most)
    met = members.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node"))).distinct()
    some = nodes.select("th", "th2", "node").join(met, "node", "left_semi")
    texts = ws.save(own.select("th", "th2", "text").join(some, ["th", "th2"]).select("node", "text").dropDuplicates(["node"]), "texts")

    def similar(batches):
        sets, held = {}, 0
        for batch in batches:
            if held > 1 << 22:
                sets, held = {}, 0
            ends = [batch.column(k).to_pylist() for k in range(2)]
            for own, texts_ in zip(ends, batch.columns[2:], strict=True):
                new = {x: i for i, x in enumerate(own) if x not in sets}
                if new:
                    sets |= zip(new, _sets(texts_.take(pa.array(list(new.values()), pa.int32())), words), strict=True)
                    held += sum(len(sets[x]) for x in new)
            good = pa.array([jaccard(sets[x], sets[y]) >= similarity for x, y in zip(*ends, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], ["u", "v"])

    def verified(pairs):
        pairs = ws.save(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "pairs", 2 * most)
        text_of = lambda end: texts.withColumnsRenamed({"node": end, "text": f"{end}_text"})
        # small tables of much work: all tasks take part, each with up to BLOCK pairs of a text or so
        parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        firsts = text_of("u").join(parts, "u").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pairs = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v", F.lit(2)), "parts")).drop("parts")
        pairs = pairs.join(text_of("v"), "v").repartition(4 * partitions(spark), "u", "part").join(firsts, ["u", "part"])
        return pairs.select("u", "v", "u_text", "v_text").mapInArrow(tidy(similar), "u long, v long")

    star = members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    star = ws.save(star.unionByName(near).distinct(), "star", 2 * most)
    roots = components(stars[0], ws.save(verified(star), "links-star"))
    apart = ws.save(placed(members, roots, "node", "rep"), "placed", most)
    ws.drop("members", "golay", "star", "pairs", "links-star")
    # the block of a text under a key, and how many blocks the key has
    block = (F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("c") / BLOCK)).alias("block"), F.ceil(F.col("c") / BLOCK).alias("blocks"))
    open_ = apart.where("node_root <> rep_root")
    left = ws.save(open_.select("k", "node", F.col("node_root").alias("root"), *block), "open", most)
    right = ws.save(apart.join(left.select("k").distinct(), "k", "left_semi").select("k", "node", F.col("node_root").alias("root"), *block), "others", most)

    def shingled(batches):
        for batch in batches:
            sets = _sets(batch.column(1), words)
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets)))])
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["node", "set"])

    needed = texts.join(right.select("node").distinct(), "node", "left_semi").select("node", "text")
    sets = ws.save(needed.mapInArrow(tidy(shingled), "node long, set array<long>"), "sets")

    def packed(rows):  # a block holds BLOCK texts or so
        return rows.join(sets, "node").groupBy("k", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("node", "root", "set")).alias("texts"))

    met = packed(left).select("k", F.col("block").alias("left_block"), F.col("texts").alias("a"))
    others = packed(right).select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("left_block"), F.col("texts").alias("b"))
    rest = met.join(others, ["k", "left_block"]).select("a", "b").mapInArrow(tidy(_blocks_compared(similarity)), "u long, v long")
    rest = ws.save(rest, "links-rest")
    roots = components(stars[1], roots.unionByName(rest))
    rows = own.select("key", "th", "th2").join(nodes.select("th", "th2", "node"), ["th", "th2"]).drop("th2")
    rows = ws.save(placed(rows, roots, "node"), "rows")
    for other in stars:
        other.drop("")
    # a table of its own: the join can then split a large component
    least = ws.save(rows.groupBy("node_root").agg(F.min("key").alias("component_id")), "least")
    return ws.result(rows.join(least, "node_root").select(F.col("key").alias(key), "th", F.col("node_root").alias("group"), "component_id"))
