"""Operator 7: nearest neighbours by collision-counting hashing with virtual rehashing.

Every vector is projected on random directions, one number each. A query's window on a
direction is centred on its own number and twice as wide each round: joining two
neighbouring buckets of a finer table without building a coarser one. A vector that
falls in the window on enough directions is verified by its exact distance. Rounds go on
for a query until enough vectors are verified and the windows are wide against the
distance of the last of its nearest.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, partitions, release

DIRECTIONS = 64
SHARE = 0.7  # of the directions on which a vector must collide
ROUNDS = 40
VERIFIED = 1 << 14  # pairs whose distances are computed at a time
BLOCK = 8192  # vectors of a block, whose projections are sorted together
BATCH = 128  # queries that widen their windows together
ASKED = 4096  # queries, on average, that meet a block in one unit of work
SEED = 7


def usable(column):
    """Not null or zero, and without null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return column.isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def directions(dims: int, n: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, n))


def sorted_projections(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the vectors on each direction, their numbers in that order)."""
    p = vectors @ directions(vectors.shape[1])
    order = np.argsort(p, axis=0, kind="stable")
    return order.T.copy(), np.take_along_axis(p, order, axis=0).T.copy()


def search_block(ids: np.ndarray, vectors: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE, rows: np.ndarray | None = None, held: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, float]]:
    """(query's place, vector, distance): up to k nearest found in one block, for each query. All queries widen their windows together.

    rows and q_rows: the numbers of the vectors' and the queries' rows, as ids may repeat; by default the vectors' ids.
    held: the block's sorted projections, where they are at hand.
    """
    rows = ids if rows is None else rows
    lines = directions(vectors.shape[1])
    q = queries @ lines
    order, sorted_ = held or sorted_projections(vectors)
    n, ways = len(ids), lines.shape[1]
    need = int(np.ceil(share * ways))
    # the narrowest window holds a few vectors on each direction, if all were evenly spread
    spread = np.maximum(sorted_[:, -1], q.max(0, initial=-np.inf)) - np.minimum(sorted_[:, 0], q.min(0, initial=np.inf))
    width = max(float(np.median(spread)) / max(n, 1) * 2, 1e-12)
    count = np.zeros((len(q_rows), n), np.int16)
    dist, seen = np.full(count.shape, np.inf), np.zeros(count.shape, bool)
    own = rows[None, :] == q_rows[:, None]
    lo = np.stack([np.searchsorted(sorted_[d], q[:, d]) for d in range(ways)])
    hi = lo.copy()
    live = np.arange(len(q_rows))
    for _ in range(ROUNDS):
        for d in range(ways):
            a = np.minimum(np.searchsorted(sorted_[d], q[live, d] - width / 2, "left"), lo[d, live])
            b = np.maximum(np.searchsorted(sorted_[d], q[live, d] + width / 2, "right"), hi[d, live])
            # what the window gained on its two sides; a vector comes once per direction
            start, size = np.concatenate([a, hi[d, live]]), np.concatenate([lo[d, live] - a, b - hi[d, live]])
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            count[np.repeat(np.concatenate([live, live]), size), order[d, at]] += 1
            lo[d, live], hi[d, live] = a, b
        i, j = np.nonzero((count[live] >= need) & ~seen[live])
        i = live[i]
        seen[i, j] = True
        for c in range(0, len(i), VERIFIED):  # pairs at a time
            a, b = i[c : c + VERIFIED], j[c : c + VERIFIED]
            dist[a, b] = np.where(own[a, b], np.inf, np.sqrt(((vectors[b] - queries[a]) ** 2).sum(1)))
        if n >= k:
            far = np.partition(dist[live], k - 1, axis=1)[:, k - 1]
        else:
            far = np.full(len(live), np.inf)
        # a vector nearer than far is off by less than far times a normal number on each direction:
        # once half the window exceeds 1.5 far, 87 % of its directions are expected to collide
        live = live[~((width / 2 >= 1.5 * far) | seen[live].all(1))]
        if not len(live):
            break
        width *= 2
    for i in live.tolist():  # windows that never grew wide enough: the rest is verified as it is
        j = np.flatnonzero(~seen[i] & ~own[i])
        dist[i, j] = np.sqrt(((vectors[j] - queries[i]) ** 2).sum(1))
    out = []
    for i in range(len(q_rows)):
        have = np.flatnonzero(np.isfinite(dist[i]))
        if len(have) > k:
            have = have[dist[i, have] <= np.partition(dist[i, have], k - 1)[k - 1]]
        # summed component by component, as SQL engines do
        exact = np.sqrt(np.cumsum((vectors[have] - queries[i]) ** 2, axis=1)[:, -1])
        best = np.lexsort((ids[have], exact))[:k]
        out += [(i, int(ids[have[j]]), float(exact[j])) for j in best]
    return out


def search(df: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance, in double precision.

    Queries are the usable vectors whose key is divisible by `every`; candidates are all
    usable vectors but the query's own. Vectors lie in blocks of bounded size; each block
    sorts its projections once and takes the queries a bounded batch at a time. A block and
    a share of the queries are a unit of work, and both go to it as rows: a block is moved
    once a share, a query once a block. So neither a task's memory nor what it returns (k
    rows a query and block) grows with the table, and nothing is broadcast. Rows are told by numbers of their own, so rows of one key meet each other, and each
    query row has its own answer. Null keys take no part; vectors of another length than the query's are no
    candidates; ties go to the smaller key; equal vectors all count; other columns are
    left out; no query gives no row. The result is a written table.

    On vectors spread evenly over a sphere (the tables': the tenth neighbour lies at 1.10,
    the median vector at 1.41) every window has to reach most vectors, so no partitioning
    of the projections would spare a query a block.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "neighbours")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = ws.save(rows.withColumns({"dims": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    blocks = max(1, -(-n // BLOCK))
    # as many shares as bound a unit's queries, or as give every partition a unit
    shares = max(-(-n_asked // ASKED), min(-(-n_asked // BATCH), -(-partitions(spark) // blocks)), 1)
    # every block meets every query once: the stated query set against all rows, in blocks
    block, part = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shares)).cast("int")
    unit, tasks = ["block", "part", "dims"], min(blocks * shares, 8 * partitions(spark))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"block": block, "part": each(shares)}).repartition(tasks, *unit)
    right = asked.withColumns({"part": part, "block": each(blocks)}).repartition(tasks, *unit)

    def numbers(table, dims):
        flat = table.combine_chunks()
        vectors = flat.column("v").combine_chunks()
        return flat.column("id").to_numpy(), vectors.flatten().to_numpy().reshape(-1, dims), flat.column("row").to_numpy()

    names = ["row", "query_id", "vec_id", "score"]

    def run(key, own, queries):
        dims, none = key[2].as_py(), np.zeros(0, np.int64)
        parts = [(none, none, none, np.zeros(0))]
        if own.num_rows and queries.num_rows:
            ids, vs, held_rows = numbers(own, dims)
            q_ids, qs, q_rows = numbers(queries, dims)
            held = sorted_projections(vs)
            for i in range(0, len(q_rows), BATCH):
                found = search_block(ids, vs, q_rows[i : i + BATCH], qs[i : i + BATCH], k, rows=held_rows, held=held)
                at = i + np.array([f[0] for f in found], np.int64)
                parts.append((q_rows[at], q_ids[at], np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.float64)))
        out = pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)
        del own, queries
        release()
        return out

    from pyspark.sql import Window

    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(run, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return ws.result(found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score"))


#: The same rows by brute force, where the search misses none (its recall is 1.0 on the tables measured).
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])))) AS score
  FROM v q JOIN v ON q.row <> v.row AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))
