"""Operator 11: the prefix trie of conversations by prefix-doubling naming.

Turns with one role and text share a number. A block of 2^k turns that starts at a multiple
of 2^k is named by the pair of names of its halves: equal blocks, and only these, get equal
names, one join round for each k. The prefix of d turns is the prefix without d's lowest
bit, followed by one block as long as this bit: rounds from the highest bit to the lowest
name all prefixes, and a prefix's name is its node. So rounds grow with the logarithm of
the longest conversation, and what is moved is numbers: texts never leave their scan.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, bases, numbered, tidy

PIECE = 1 << 16  # characters of joined keys that travel as one row


def named(ws: Workspace, rows: DataFrame, keys: list[str], name: str, at: int, most: int) -> tuple[DataFrame, int]:
    """(keys, name): the rows' distinct keys with dense names from `at` on; and the first name after them."""
    own = rows.select(*keys).distinct().withColumn("_m", F.monotonically_increasing_id())
    own = ws.save(own, name, most).withColumn("_part", F.shiftright("_m", 33).cast("int"))
    before = bases(own, {"": F.lit(1)})
    out = own.join(F.broadcast(before), "_part").select(*keys, (F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1) + at).alias("name"))
    return out, at + own.count()


def turns(ws: Workspace, df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(c, i, name, bytes): each conversation's turns from 0, their contents' dense names and the text's UTF-8 bytes.

    Turns go by `order`, null first; those of one order value by role, then text. Only texts of
    such ties are moved; others are told by 256 bits of hash, taken in the scan. Null role or
    text is empty; a null key takes no part.
    """
    rows = df.select(F.col(key).cast("long").alias("c"), F.col(order).alias("o"), *(F.coalesce(F.col(x), F.lit("")).alias(a) for x, a in ((role, "role"), (text, "text")))).where("c is not null")
    mark = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("mark", mark)
    narrow = ws.save(rows.select("c", "o", "mark", F.octet_length("text").alias("bytes"), F.monotonically_increasing_id().alias("u")), "turns")
    n = narrow.count()
    tied = narrow.groupBy("c", "o").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("c", "o")
    narrow = narrow.withColumn("r", F.lit(0).cast("long"))
    if not tied.isEmpty():
        same = (rows["c"] == tied["c"]) & rows["o"].eqNullSafe(tied["o"])
        contents = ws.save(rows.join(tied, same, "left_semi").select("role", "text", "mark").distinct(), "tied")
        ranks = numbered(ws, contents, ["role", "text"], "tied-ranks").select("mark", (F.col("pos") + 1).alias("q"))
        narrow = narrow.join(ranks, "mark", "left").withColumn("r", F.coalesce("q", "r")).drop("q")
    names, _ = named(ws, narrow, ["mark"], "contents", 0, n)
    rows = ws.save(narrow.join(names, "mark").drop("mark"), "turns-named", n)
    placed = numbered(ws, rows, ["c", "o", "r", "u"], "turns-placed").select("c", "pos", "name", "bytes")
    first = placed.groupBy("c").agg(F.min("pos").alias("first"))
    return ws.save(placed.join(first, "c").select("c", (F.col("pos") - F.col("first")).alias("i"), "name", "bytes"), "own", n)


def spliced(ws: Workspace, own: DataFrame, base, most: int, cut) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: (c, j, name, bytes) and (c, size).

    The first cut(c) turns are those of conversation base(c) (all if it has fewer, none if it is
    absent), the others c's own after its first cut(c). most: what cut never exceeds.
    """
    sizes = own.groupBy("c").agg(F.count("*").alias("n"))
    sizes = ws.save(sizes.withColumns({"h": cut(F.col("c")).cast("long"), "b": base(F.col("c"))}), "sizes", own.count())
    other = sizes.select(F.col("c").alias("b"), F.col("n").alias("m"))
    sizes = sizes.join(other, "b", "left").withColumn("m", F.least("h", F.coalesce("m", F.lit(0)))).select("c", "h", "b", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    sizes = ws.save(sizes, "spliced-sizes", own.count())
    rest = own.where(F.col("i") >= cut(F.col("c"))).join(sizes, "c").select("c", (F.col("i") - F.col("h") + F.col("m")).alias("j"), "name", "bytes")
    heads = own.where(F.col("i") < most).withColumnRenamed("c", "b").join(sizes, "b").where("i < h").select("c", F.col("i").alias("j"), "name", "bytes")
    return ws.save(rest.unionByName(heads), "spliced"), sizes.select("c", "size")


def prefixes(ws: Workspace, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, d, node): the node of each conversation's first d turns, for d from 0 (node 0) to its size."""
    longest, n = convs.agg(F.max("size")).first()[0] or 0, rows.count()
    blocks, k = [rows.select("c", "j", "name")], 0
    while 2 << k <= longest:
        k += 1
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("c", F.shiftright("j", 1).alias("i")).agg(half(0).alias("a"), half(1).alias("b")).where("b is not null").withColumnRenamed("i", "j")
        pairs = ws.save(pairs, f"pairs{k}", n >> k)
        names, _ = named(ws, pairs, ["a", "b"], f"names{k}", 0, n >> k)
        blocks.append(ws.save(pairs.join(names, ["a", "b"]).select("c", "j", "name"), f"blocks{k}", n >> k))
    out, at = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node")), 1
    for k in reversed(range(len(blocks) if longest else 0)):
        # a block that starts at an even multiple of its length ends a prefix whose lowest bit it is
        ends = blocks[k].where("j % 2 = 0").select("c", F.shiftleft("j", k).alias("d"), F.col("name").alias("b"))
        pairs = ws.save(ends.join(out.withColumnRenamed("node", "a"), ["c", "d"]), f"ends{k}", (n >> k) + 1)
        names, at = named(ws, pairs, ["a", "b"], f"nodes{k}", at, (n >> k) + 1)
        found = pairs.join(names, ["a", "b"]).select("c", (F.col("d") + (1 << k)).alias("d"), F.col("name").alias("node"))
        out = out.unionByName(ws.save(found, f"prefixes{k}", (n >> k) + 1))
    return out


def trie(ws: Workspace, rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and (node, c) of the conversations that end at each.

    rows: (c, j, name, bytes), convs: (c, size), sizes of 0 too. A node has its depth, the
    smallest conversation through it (conv_id), parent's node and conv_id, n_convs, n_children,
    n_leaves and saved (see `query`). A conversation owns the nodes whose smallest it is: a path
    that ends at its last turn. So what a subtree holds is the sum, over the conversations
    through its top, of what they own, less what its own owner owns above it; no walk over the
    tree is needed, however deep.
    """
    all_ = prefixes(ws, rows, convs)
    most = rows.count() + convs.count()
    nodes = all_.groupBy("node").agg(F.first("d").alias("depth"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    above = all_.select(F.col("c").alias("conv_id"), (F.col("d") + 1).alias("depth"), F.col("node").alias("parent"))
    last = rows.select(F.col("c").alias("conv_id"), (F.col("j") + 1).alias("depth"), "bytes")
    nodes = nodes.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left")
    nodes = ws.save(nodes.withColumn("own", (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))), "nodes", most)
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = ws.save(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children", most)
    nodes = numbered(ws, nodes, ["conv_id", "depth"], "nodes-placed", ("own",)).drop("pos", "bytes")
    owners = nodes.groupBy("conv_id").agg(F.sum("own").alias("owned"), F.min("before_own").alias("first"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf"))
    owners = ws.save(owners, "owners", most)
    sums = all_.join(owners.withColumnRenamed("conv_id", "c"), "c").groupBy("node").agg(F.sum("owned").alias("through"), F.sum("leaf").alias("n_leaves"))
    tops = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(owners.select("conv_id", "first"), "conv_id").join(sums, "node").join(tops, "parent", "left")
    out = out.withColumn("saved", F.col("through") - (F.col("before_own") - F.col("first")))
    ends = all_.join(convs.withColumnRenamed("size", "d"), ["c", "d"]).select("node", "c")
    return out.select("node", "depth", "conv_id", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"), ends


def digests(ws: Workspace, ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the node's conversations' decimal keys, ascending, joined by commas.

    Keys are sorted by range and joined piece by piece, so one node's keys are dealt over many
    tasks. A hash takes its pieces one after the other; it reads them as they come and holds none.
    """

    def joined(batches):
        node, first, held = None, None, []
        size = 0

        def row():
            return pa.RecordBatch.from_pylist([{"node": node, "c": first, "keys": ",".join(held)}], schema=pa.schema([("node", pa.int64()), ("c", pa.int64()), ("keys", pa.string())]))

        out = []
        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (n != node or size > PIECE):
                    out.append(row())
                    held, size = [], 0
                if not held:
                    node, first = n, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if held:
            yield row()

    def hashed(batches):
        node, state = None, None
        for b in batches:
            done = []
            for n, keys in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if n != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(keys.encode())
                else:
                    state.update(b"," + keys.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done])], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ends = ws.save(ends, "ends")
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(parts, "node", "c").sortWithinPartitions("node", "c").mapInArrow(tidy(joined), "node long, c long, keys string")
    return pieces.repartition("node").sortWithinPartitions("node", "c").mapInArrow(tidy(hashed), "node long, ends_sha256 string")


def shared_first(c):
    """How many of a conversation's first turns are its base's."""
    return F.crc32(c.cast("string")) % 9


def query(spark, sf_dir: str) -> DataFrame:
    """Per node of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    No conversation gives no row, not even the root's. The result is a written table.
    """
    ws = Workspace(spark, "trie")
    own = turns(ws, spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")), "conv_id", "turn", "role", "text")
    rows, convs = spliced(ws, own, lambda c: c - c % 5, 8, shared_first)
    nodes, ends = trie(ws, rows, convs)
    out = nodes.join(digests(ws, ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return ws.result(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"))


#: The same rows: prefixes are compared as lists, a node's subtree as all nodes that begin with it.
ORACLE = """
WITH crc AS (
  SELECT conv_id AS c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(CAST(conv_id AS VARCHAR)[i])::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT o.c, list_concat(coalesce(b.l[:crc.h], []), o.l[crc.h + 1:]) AS l FROM own o JOIN crc USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 5),
prefix AS (SELECT c, d, l[:d] AS p, len(l) = d AS ended FROM built, unnest(range(len(l) + 1)) AS u(d)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].t) END AS s, coalesce(string_agg(CASE WHEN ended THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM prefix GROUP BY p, d),
up AS (SELECT n.*, u.conv_id AS parent FROM node n LEFT JOIN node u ON u.d = n.d - 1 AND u.p = n.p[:n.d - 1]),
-- a node's conversation and depth tell which it is
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids USING (conv_id, d)),
tree AS (
  SELECT a.conv_id, a.d, sum(b.s) AS saved, sum(CASE WHEN b.k = 0 THEN 1 ELSE 0 END) AS leaves
  FROM full_ b JOIN prefix x ON x.c = b.conv_id AND x.d <= b.d JOIN node a ON a.d = x.d AND a.p = x.p GROUP BY a.conv_id, a.d)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, CAST(k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_ JOIN tree USING (conv_id, d)
"""
