"""Operator 13: exact top-k by inner product, a dual-tree search over cover trees.

All vectors, queries among them, lie in one tree. Its upper levels are tables: a cell of many
vectors is divided among separated centres, round by round, until cells are blocks of bounded
size. A block's own tree is built where it is searched: points of a level lie apart by more
than the level's radius, and each point lies within it of one of them. A node pair (queries,
data) can hold no product above <c, d> + r_d |c| + r_c |d| + r_c r_d, with centres c and d and
covering radii r; it goes no further if this is below the worst kth score of its queries.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, partitions, tidy

BLOCK = 4096  # vectors of a block
FAN = 32  # centres that a cell is divided among
SAMPLE = 512  # vectors of a cell among which its centres are chosen; all of its vectors are then dealt out and measured
BATCH = 128  # queries of a group, on average
LEAF = 4  # a tree ends where its nodes hold so many points on average
EXACT = float(1 << 52)  # products below it are whole numbers of a double
LONG = (1 << 63) - 1


def whole(column):
    """Components as floor(256 x), in double precision; null for a vector that takes no part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == F.lit(float("inf"))))
    # from 2^53 on a double has no fraction
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(column, lambda x: F.when(F.abs(x * 256) < 2.0**53, F.floor(x * 256).cast("double")).otherwise(x * 256)))


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Infinite where squares don't fit a double: then nothing is pruned."""
    with np.errstate(over="ignore"):
        return np.sqrt(((points - centre) ** 2).sum(-1))


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """Numbers of at most so many different points, each the farthest from those before it."""
    chosen, far = [0], distances(points, points[0])
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        np.minimum(far, distances(points, points[chosen[-1]]), out=far)
    return np.array(chosen)


class Tree:
    """A cover tree by levels, from one node down to all points.

    at: the points that are a level's nodes, those of the level above first; up: each node's parent;
    own: each point's node; radius: how far the farthest point below a node lies from it.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.points, self.norms = points, distances(points, 0)
        far, near = distances(points, points[0]), np.zeros(n, np.int64)
        self.at, self.up = [np.array([0])], [np.zeros(1, np.int64)]
        apart = far.max() / 2
        while 0 < apart < np.inf and len(self.at[-1]) * LEAF < n:
            above, nodes = near.copy(), list(self.at[-1])
            while len(nodes) * LEAF < n and far.max() > apart:
                k = int(far.argmax())
                d = distances(points, points[k])
                far, near = np.minimum(far, d), np.where(d < far, len(nodes), near)
                nodes.append(k)
            self.at.append(np.array(nodes))
            self.up.append(above[nodes])
            apart /= 2
        self.at.append(np.arange(n))
        self.up.append(near)
        self.own, self.radius = [np.arange(n)], [np.zeros(n)]
        for up, at in zip(self.up[:0:-1], self.at[-2::-1], strict=True):
            self.own.append(up[self.own[-1]])
            self.radius.append(np.zeros(len(at)))
            np.maximum.at(self.radius[-1], self.own[-1], distances(points, points[at[self.own[-1]]]))
        self.own.reverse()
        self.radius.reverse()


class Best:
    """The k highest scores of each query, of equal ones the smaller keys'."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor  # a query's kth score so far, found elsewhere
        self.score, self.key = np.full((len(floor), k), -np.inf), np.full((len(floor), k), LONG)

    def worst(self) -> np.ndarray:
        last = self.score[:, -1]
        if last.dtype == object:
            last = np.array([float(min(x, 1e300)) if x > -1e300 else -np.inf for x in last])
        return np.maximum(last, self.floor)

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of all queries with these keys' vectors; -inf where they don't count."""
        if scores.dtype == object:
            every = [sorted(zip(*(x.tolist() for x in pair), strict=True), key=lambda x: (-x[0], x[1]))[: self.k] for pair in zip(np.hstack([self.score.astype(object), scores]), np.hstack([self.key, np.broadcast_to(keys, scores.shape)]), strict=True)]
            self.score, self.key = (np.array([[x[j] for x in row] for row in every], t) for j, t in ((0, object), (1, np.int64)))
            return
        for c in range(0, len(keys), 1024):
            s = np.hstack([self.score, scores[:, c : c + 1024]])
            i = np.hstack([self.key, np.broadcast_to(keys[c : c + 1024], (len(s), len(keys[c : c + 1024])))])
            first = np.lexsort((i, -s), axis=1)[:, : self.k]
            self.score, self.key = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: in doubles while they fit, else in whole numbers of any size."""
    if a.shape[1] * float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) < EXACT:
        return a @ b.T
    to = np.frompyfunc(int, 1, 1)
    return to(a).astype(object) @ to(b).astype(object).T


def dual(left: Tree, q_uids: np.ndarray, right: Tree, uids: np.ndarray, keys: np.ndarray, best: Best) -> None:
    """Offer best every point of the right tree that can be among the k highest of a left point.

    Both trees go down level by level. Nodes are points themselves: one that is new at a level is
    scored with the queries of the node pairs that are left, so thresholds rise on the way. A query
    whose node was pruned with this node's parent needs it no more.
    """
    alive, scored = np.ones((1, 1), bool), np.zeros(len(right.points), bool)
    slack = 1e-9 * (min(left.norms.max(), 1e150) * min(right.norms.max(), 1e150) + 1)
    for level in range(max(len(left.at), len(right.at))):
        a, b = min(level, len(left.at) - 1), min(level, len(right.at) - 1)
        if 0 < level < len(left.at):
            alive = alive[left.up[a]]
        if 0 < level < len(right.at):
            alive = alive[:, right.up[b]]
        c, d, rc, rd = left.at[a], right.at[b], left.radius[a][:, None], right.radius[b][None]
        with np.errstate(over="ignore", invalid="ignore"):
            bound = left.points[c] @ right.points[d].T + rd * left.norms[c][:, None] + rc * right.norms[d][None] + rc * rd + slack
        worst = np.full(len(c), np.inf)
        np.minimum.at(worst, left.own[a], best.worst())
        alive = alive & ~(bound < worst[:, None])
        new = np.flatnonzero(alive.any(0) & ~scored[d])
        if len(new):
            s = products(left.points, right.points[d[new]])
            counts = alive[left.own[a]][:, new] & (q_uids[:, None] != uids[d[new]][None])
            best.offer(np.where(counts, s, -np.inf), keys[d[new]])
            scored[d[new]] = True


def divided(ws: Workspace, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, id, asked, v, dims, cell) with cells of about BLOCK rows, and the tree's nodes above and in them.

    A cell of more rows has up to FAN centres, the farthest apart of SAMPLE of its rows (those of the
    smallest hashes); every row goes to the nearest. Where most rows of a cell go on together, as
    copies of one vector do, they are numbered into blocks that share their centre and radius.
    nodes: (cell, parent, centre, radius, spread), spread being the radius of the queries alone.
    """
    left = ws.save(rows.withColumns({"cell": F.col("dims").cast("string"), "dist": F.lit(float("inf")), "up": F.lit(None).cast("long"), "centre": F.array().cast("array<double>")}), "cells0")
    done, nodes, k = [], [], 0
    while True:
        cells = left.groupBy("cell").agg(F.count("*").alias("n"), F.first("up").alias("up"), F.max("dist").alias("radius"), F.coalesce(F.max(F.when(F.col("asked"), F.col("dist"))), F.lit(-1.0)).alias("spread"), F.first("centre").alias("centre"))
        cells = ws.save(cells.withColumn("parent", F.when(F.col("up").isNotNull(), F.regexp_replace("cell", "/[^/]*$", ""))), f"counts{k}")
        nodes.append(cells.select("cell", "parent", "centre", "radius", "spread"))
        alike = (F.col("n") > BLOCK) & (F.col("n") * 2 > F.col("up"))
        parts = cells.where(alike).select("cell", "centre", "radius", "spread", F.ceil(F.col("n") / BLOCK).alias("parts"))
        each = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        nodes.append(each.select(F.concat("cell", F.lit("/"), F.col("part").cast("string")).alias("cell"), F.col("cell").alias("parent"), "centre", "radius", "spread"))
        plain = ["uid", "id", "asked", "v", "dims", "cell"]
        done.append(left.join(cells.where(f"n <= {BLOCK}").select("cell"), "cell", "left_semi").select(*plain))
        done.append(left.select(*plain).join(parts.select("cell", "parts"), "cell").withColumn("cell", F.concat("cell", F.lit("/"), F.pmod(F.xxhash64("uid"), "parts").cast("string"))).select(*plain))
        big = cells.where(f"n > {BLOCK}").where(~F.coalesce(alike, F.lit(False))).select("cell", "n")
        if big.isEmpty():
            break
        few = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("uid"), "uid"))
        few = left.select("cell", "uid", "v").join(big, "cell", "left_semi").withColumn("few", few).where(F.col("few") <= SAMPLE)
        few = few.groupBy("cell").agg(F.collect_list("v").alias("vs"))  # at most SAMPLE

        def choose(batches):
            for b in batches:
                cells = b.column(0).to_pylist()
                got = [matrix(b.column(1).slice(r, 1).flatten()) for r in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array([vs[farthest_first(vs, FAN)].tolist() for vs in got], pa.list_(pa.list_(pa.float64())))], ["cell", "centres"])

        centres = ws.save(few.mapInArrow(tidy(choose), "cell string, centres array<array<double>>"), f"centres{k}")
        pieces = left.select(*plain).join(big, "cell").withColumn("piece", F.pmod(F.xxhash64("uid", F.lit(k)), F.ceil(F.col("n") / 1024)))
        pieces = pieces.groupBy("cell", "piece").agg(F.first("n").alias("n"), F.collect_list(F.struct("uid", "id", "asked", "v")).alias("rows")).join(centres, "cell")

        def deal(batches):
            for b in batches:
                for r in range(b.num_rows):
                    part = b.slice(r, 1)
                    held, at = part.column(3).flatten(), matrix(part.column(4).flatten())
                    vs = matrix(held.field(3))
                    far = np.stack([distances(vs, c) for c in at], axis=1)
                    to = far.argmin(1)
                    cell, n = part.column(0)[0].as_py(), part.column(2)[0].as_py()
                    own = pa.array(at[to].ravel())
                    own = pa.ListArray.from_arrays(pa.array(np.arange(len(vs) + 1, dtype=np.int32) * vs.shape[1]), own)
                    yield pa.RecordBatch.from_arrays(
                        [held.field(0), held.field(1), held.field(2), held.field(3), pa.array(np.full(len(vs), vs.shape[1], np.int32)), pa.array([f"{cell}/{t}" for t in to.tolist()]), pa.array(far[np.arange(len(vs)), to]), pa.array(np.full(len(vs), n, np.int64)), own],
                        names=["uid", "id", "asked", "v", "dims", "cell", "dist", "up", "centre"],
                    )

        k += 1
        left = ws.save(pieces.mapInArrow(tidy(deal), "uid long, id long, asked boolean, v array<double>, dims int, cell string, dist double, up long, centre array<double>"), f"cells{k}")
    blocks, tree = done[0], nodes[0]
    for d in done[1:]:
        blocks = blocks.unionByName(d)
    for d in nodes[1:]:
        tree = tree.unionByName(d)
    return ws.save(blocks, "blocks"), ws.save(tree, "nodes")


def matrix(lists) -> np.ndarray:
    """Vectors of one length as rows."""
    n = len(lists)
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def found_in(k: int):
    """A function of rows (block, salt, qblock, rows), sorted by block and salt, each block's own row (without qblock)
    before the groups of queries that search it. Returns (uid, query_id, vec_id, score)."""

    def run(batches):
        at, tree, uids, keys = None, None, None, None
        for b in batches:
            for r in range(b.num_rows):
                part = b.slice(r, 1)
                held, queries = part.column(3).flatten(), part.column(2)[0].as_py()
                vs = matrix(held.field(3))
                if queries is None:
                    at, tree, uids, keys = part.column(0)[0].as_py(), Tree(vs), held.field(0).to_numpy(), held.field(1).to_numpy()
                    continue
                assert at == part.column(0)[0].as_py()
                own, ids, floor = held.field(0).to_numpy(), held.field(1).to_numpy(), held.field(2).to_numpy()
                best = Best(k, floor)
                dual(Tree(vs), own, tree, uids, keys, best)
                i, j = np.nonzero((best.score != -np.inf) & (best.score >= floor[:, None]))
                score = [max(-LONG - 1, min(LONG, int(x))) for x in best.score[i, j].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[i]), pa.array(best.key[i, j]), pa.array(score, pa.int64())], ["uid", "query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with any other row, exact.

    Queries are the rows whose key is divisible by `every`; candidates all rows but the query's own,
    told by row, so rows of one key meet each other, and each query row has its own answer. Components
    count as floor(256 x). Null keys, null vectors and vectors with null or non-finite components take
    no part; vectors of other lengths are no candidates; zero and empty vectors are vectors like others.
    Ties go to the smaller key. Scores beyond a long are its bounds, and tie. No query gives no row.

    First each block's queries search their own block, which gives thresholds. Then pairs of nodes go
    down the tree from its top, each round in equi joins with both sides' children, and are dropped by
    the bound; the pairs of blocks that are left are searched: a block's vectors move once (or once in
    as many groups of queries as a task takes), queries only to the blocks they can't rule out. Where
    vectors are spread so evenly that no bound excludes anything, as in the tables, each query reaches
    each block, which is what an exact search has to do there. The result is a written table.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "covertree")
    rows = df.select(F.col(key).cast("long").alias("id"), whole(F.col(vector).cast("array<double>")).alias("v")).where("id is not null and v is not null")
    rows = ws.save(rows.select(F.monotonically_increasing_id().alias("uid"), "id", (F.col("id") % every == 0).alias("asked"), "v", F.size("v").alias("dims")), "vectors")
    blocks, nodes = divided(ws, rows)

    low = F.lit(float("-inf"))
    held = blocks.groupBy("cell").agg(F.collect_list(F.struct("uid", "id", low.alias("floor"), "v")).alias("rows"))  # about BLOCK rows
    groups = blocks.where("asked").groupBy("cell").agg(F.ceil(F.count("*") / BATCH).alias("groups"))
    asked = blocks.where("asked").join(groups, "cell").withColumn("g", F.pmod(F.xxhash64("uid", F.lit(2)), "groups"))
    own = asked.groupBy("cell", "g").agg(F.collect_list(F.struct("uid", "id", low.alias("floor"), "v")).alias("rows"))

    def searched(held, asked):
        """held: (block, salt, rows), asked: (block, salt, qblock, rows)."""
        both = held.join(asked.select("block", "salt").distinct(), "block").select("block", "salt", F.lit(None).cast("string").alias("qblock"), "rows").unionByName(asked)
        both = both.repartition(partitions(spark), "block", "salt").sortWithinPartitions("block", "salt", F.col("qblock").asc_nulls_first())
        return both.mapInArrow(tidy(found_in(k)), "uid long, query_id long, vec_id long, score long")

    held = held.withColumnRenamed("cell", "block")
    first = ws.save(searched(held, own.select(F.col("cell").alias("block"), F.lit(0).cast("long").alias("salt"), F.col("cell").alias("qblock"), "rows")), "first")
    # a query's threshold: its kth score so far, if it has k
    floor = first.groupBy("uid").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("c"))
    # beyond 2^52 a double may be off by a little, and a score at a long's bounds by any amount
    floor = floor.where(f"c >= {k} and abs(least) < {LONG // 2}").select("uid", F.when(F.abs("least") < EXACT, F.col("least")).otherwise(F.col("least") - F.abs("least") * 1e-9).alias("least"))
    asked = ws.save(asked.join(floor, "uid", "left").select("uid", "id", "v", "cell", "g", F.coalesce("least", low).alias("floor")), "asked")

    pairs = _pairs(ws, nodes, asked)
    salts = pairs.join(asked.select(F.col("cell").alias("q"), "g").distinct(), "q").select("r", "q", "g")
    to = salts.withColumn("salt", F.pmod(F.xxhash64("q", "g"), F.lit(_spread(spark, salts)))).withColumnsRenamed({"r": "block"})
    sets = asked.groupBy("cell", "g").agg(F.collect_list(F.struct("uid", "id", "floor", "v")).alias("rows")).withColumnRenamed("cell", "q")
    sets = to.join(sets, ["q", "g"]).select("block", "salt", F.col("q").alias("qblock"), "rows")
    found = first.unionByName(searched(held, sets))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return ws.result(found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score"))


def _pairs(ws: Workspace, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, r): blocks of queries and other blocks of vectors that the bound does not rule out."""
    floors = asked.groupBy("cell").agg(F.min("floor").alias("floor"))
    depth = F.size(F.split("cell", "/"))
    deepest = nodes.agg(F.max(depth)).first()[0] or 0
    # each node's threshold is the least of the queries' below it
    up, level = floors, floors
    for _ in range(deepest - 1):
        level = level.where(F.contains("cell", F.lit("/"))).groupBy(F.regexp_replace("cell", "/[^/]*$", "").alias("cell")).agg(F.min("floor").alias("floor"))
        up = up.unionByName(level)
    up = ws.save(up.groupBy("cell").agg(F.min("floor").alias("floor")), "floors")
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    told = ws.save(nodes.withColumn("norm", norm), "told")
    left = told.join(up, "cell").select(*(F.col(a).alias(b) for a, b in (("cell", "q"), ("centre", "qc"), ("norm", "qn"), ("spread", "qr"), ("floor", "floor"))))
    right = told.select(*(F.col(a).alias(b) for a, b in (("cell", "r"), ("centre", "rc"), ("norm", "rn"), ("radius", "rr"))))
    down = told.where("parent is not null").select("parent", "cell")
    q_down = down.join(up, "cell", "left_semi")
    top = told.where("parent is null").select("cell")
    pairs = ws.save(top.join(up, "cell", "left_semi").select(F.col("cell").alias("q"), F.col("cell").alias("r")), "pairs0")
    dot = F.aggregate(F.zip_with("qc", "rc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    for k in range(1, deepest):
        next_ = pairs.join(q_down.select(F.col("parent").alias("q"), F.col("cell").alias("q2")), "q", "left").select(F.coalesce("q2", "q").alias("q"), "r")
        next_ = next_.join(down.select(F.col("parent").alias("r"), F.col("cell").alias("r2")), "r", "left").select("q", F.coalesce("r2", "r").alias("r"))
        next_ = next_.join(left, "q").join(right, "r")
        bound = dot + F.col("rr") * F.col("qn") + F.col("qr") * F.col("rn") + F.col("qr") * F.col("rr")
        slack = 1e-9 * ((F.col("qn") + F.col("qr")) * (F.col("rn") + F.col("rr")) + 1)
        pairs = ws.save(next_.where((F.col("rr") == float("inf")) | (bound + slack >= F.col("floor"))).select("q", "r"), f"pairs{k}")
    return pairs.where("q <> r")


def _spread(spark, groups: DataFrame) -> int:
    """So many shares of a block's groups of queries that none has many more than a task's part of all."""
    most = groups.groupBy("r").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    return max(1, -(-most // 256))


#: The same rows by brute force.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v ON q.row <> v.row AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))
