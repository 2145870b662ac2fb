"""Connected components by alternating stars, with every link kept in tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, tidy

FEW = 500_000  # links (16 bytes each) that one task connects at once


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links of one task, without the smallest nodes themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # hook the larger root of each link below the smaller, then shorten all paths
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            short = new[new]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _contract(batches):
    """Each task's links as stars; a star needs no more links than nodes."""
    held, size = [], 0

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        u, v = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size > 2_000_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(ws: Workspace, links: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for each node of links (u, v longs) but the smallest ones.

    Rounds of large and small stars (each node hands its neighbours its smallest
    neighbour); their number grows with the logarithm of the longest chain. Every
    round is a written table, so a lost executor costs one round's reads. Minima are
    partial aggregates, so a node with very many links meets no single task. Up to FEW
    links need no rounds: one task connects them, as each round's plans and their tasks
    in every partition cost the driver more than so few links are worth. rows: how many
    links there are at most, if that is known.
    """
    edges = ws.save(links.select("u", "v").where("u <> v").mapInArrow(tidy(_contract), "u long, v long").distinct(), "links0", rows)
    seen = None
    for k in range(most_rounds):
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return edges
        if mark[0] <= FEW:
            return ws.save(edges.coalesce(1).mapInArrow(tidy(_contract), "u long, v long"), "forest")
        seen = mark
        # large star: v > u goes to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every link points down; all ends go to the smallest
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("w"), "m").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        # stars have no more links than there were
        edges = ws.save(small, f"links{k + 1}", 2 * mark[0])
        if k:
            ws.drop(f"links{k}")
    raise RuntimeError("the components did not settle")
