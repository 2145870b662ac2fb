"""Operator 12: how far the sources of a language differ in their words, by integer-dictionary encoding.

Texts are cut into terms by byte classes, and each batch's terms are counted once. Counts
are sorted by language and term, range by range, so each task makes the sorted array of the
terms that are kept in its range, finds the rows' ids in it by binary search, and counts
them by id for each source. Ids keep the terms' UTF-8 order: (range, chunk, id) breaks ties
as the terms would, and a chunk's counts are dense vectors, however large the dictionary.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, partitions, portions, text_buffers, tidy

LEAST = 10  # documents of a language that a kept term has
CHUNK = 8192  # kept terms of a chunk
TILE = 32  # sources that are compared with as many others in one task
TOP = 10
SCALE = 1_000_000_000
EXACT = 1 << 53  # amounts below it are divided in machine integers


def classes() -> tuple[np.ndarray, np.ndarray]:
    """(byte to byte with A-Z lower-cased, whether it belongs to a term)."""
    b = np.arange(256)
    upper = (b >= 0x41) & (b <= 0x5A)
    return np.where(upper, b + 32, b).astype(np.uint8), upper | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of these texts, dictionary-encoded, and each one's text."""
    low, inside = classes()
    held = np.zeros(len(data) + 1, bool)
    held[:-1] = inside[data]
    # a term ends with its text
    start = held[:-1].copy()
    start[1:] &= ~held[:-2]
    edge = offs[1:-1][offs[1:-1] < len(data)]
    start[edge] = held[edge]
    begin = np.flatnonzero(start)
    kept = np.flatnonzero(held[:-1])
    # the terms' bytes without what lies between them, and where each begins there
    ends = np.append(np.searchsorted(kept, begin), len(kept)).astype(np.int64)
    joined = low[data[kept]]
    terms = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(joined)])
    return terms.dictionary_encode(), np.searchsorted(offs, begin, "right") - 1


def counted(batches):
    """(lang, source, term, n, df) of each portion of (lang, source, text)."""
    names = ["lang", "source", "term", "n", "df"]
    for batch in portions(batches, 2, 1 << 22):
        coded, text = terms_of(*text_buffers(batch.column(2)))
        if not len(coded):
            continue
        # the two columns' codes together name a group
        l, s = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = l.indices.to_numpy().astype(np.int64) * len(s.dictionary) + s.indices.to_numpy()
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        width = len(coded.dictionary)
        code = coded.indices.to_numpy().astype(np.int64)
        # distinct (text, term) with their counts, then summed by group
        pairs, n = np.unique(text * width + code, return_counts=True)
        keys, at = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        df = np.bincount(at)
        rows = pa.array(first[keys // width])
        term = coded.dictionary.take(pa.array(keys % width)).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), term, pa.array(total), pa.array(df.astype(np.int64))], names)


CODED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])


def coder(least: int, size: int):
    """A function of rows (lang, source, term, n, df), sorted by lang and term, that returns chunks.

    A chunk has a row without a source, its dictionary (terms), and for each source that uses
    them its terms' ids, counts and counts in the whole language.
    """

    def encode(rows: pa.Table, part: int, chunk: int):
        """The chunks of some whole terms of one language."""
        rows = rows.combine_chunks()
        lang, run = rows.column("lang")[0].as_py(), rows.column("term").combine_chunks().dictionary_encode()
        code = run.indices.to_numpy()  # terms are sorted, so codes ascend
        kept = np.bincount(code, weights=rows.column("df").to_numpy()) >= least
        values = np.array([t.encode() for t in run.dictionary.to_pylist()], object)
        words = values[kept]
        # where the sorted kept terms have each term of the rows, if they do
        place = np.where(kept, np.searchsorted(words, values), -1)
        ids = place[code]
        rows, ids = rows.filter(pa.array(ids >= 0)), ids[ids >= 0]
        if not len(ids):
            return []
        source = rows.column("source").combine_chunks().dictionary_encode()
        n, whose, out = rows.column("n").to_numpy(), source.indices.to_numpy(), []
        for k in range(0, len(words), size):
            here = (ids >= k) & (ids < k + size)
            i, own, w = ids[here] - k, n[here], whose[here]
            most = min(size, len(words) - k)
            total = sums(i, own, most)
            head = {"part": part, "chunk": chunk + k // size, "lang": lang}
            out.append(head | {"source": None, "terms": [t.decode() for t in words[k : k + size]]})
            for g in np.unique(w).tolist():
                counts = sums(i[w == g], own[w == g], most)
                at = np.flatnonzero(counts)
                out.append(head | {"source": source.dictionary[g].as_py(), "ids": at.astype(np.int32), "n": counts[at], "wide": total[at]})
        return out

    def run(batches):
        from pyspark import TaskContext

        part, chunk, held, size_held = TaskContext.get().partitionId(), 0, [], 0

        def emit(rows: pa.Table):
            """Encoded chunks of the rows, language by language."""
            nonlocal chunk
            langs = rows.column("lang").combine_chunks().dictionary_encode()
            for g in range(len(langs.dictionary)):
                got = encode(rows.filter(pc.equal(langs.indices, g)), part, chunk)
                if got:
                    chunk = got[-1]["chunk"] + 1
                    for k in range(0, len(got), 64):
                        yield pa.RecordBatch.from_pylist(got[k : k + 64], schema=CODED)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            size_held += b.num_rows
            if size_held < 4 * size:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            # the last term may go on in the next batch
            same = pc.and_(pc.equal(rows.column("term"), rows.column("term")[-1]), pc.equal(rows.column("lang"), rows.column("lang")[-1])).to_numpy()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from emit(rows.slice(0, cut))
            held, size_held = [rows.slice(cut)], rows.num_rows - cut
        if size_held:
            yield from emit(pa.concat_tables(held).combine_chunks())

    return run


def sums(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of n by id, exact: in two halves, as bincount adds floating-point numbers."""
    low = np.bincount(ids, weights=n & 0xFFFFFF, minlength=size).astype(np.int64)
    return (np.bincount(ids, weights=n >> 24, minlength=size).astype(np.int64) << 24) + low


def share(n, total: int):
    """1 + floor(SCALE * n / total), exact: digits of long division while they fit, else whole numbers of any size."""
    n = np.asarray(n, np.int64)
    if total >= EXACT // 4:
        return np.array([1 + SCALE * int(x) // total for x in n.ravel()], np.int64).reshape(n.shape)
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gap(p, q):
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so squares fit."""
    return (p - q) * (p - q) // (p + q)


def tops(k: int):
    """A function of a chunk's rows with the totals (own, whole, kept) that returns each source's k largest terms, by id."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("id", pa.int32()), ("value", pa.int64())])

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n, whole = np.array(r["n"], np.int64), np.array(r["wide"], np.int64)
                p, q = share(n + 2, r["own"] + 2 * r["kept"]), share(whole + 2, r["whole"] + 2 * r["kept"])
                ids, value = np.array(r["ids"], np.int32)[p > q], gap(p, q)[p > q]
                for j in np.lexsort((ids, -value))[:k].tolist():
                    out.append({x: r[x] for x in ("lang", "source", "part", "chunk")} | {"id": int(ids[j]), "value": int(value[j])})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def gaps(batches):
    """(lang, a, b, value, present): for each two sources of a unit, the sum over the terms that one of them has, and their number."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("present", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            held = {x["source"]: x for x in r["rows"]}
            terms, ids = np.unique(np.concatenate([np.array(x["ids"], np.int32) for x in held.values()]), return_inverse=True)
            cuts = np.cumsum([0, *(len(x["ids"]) for x in held.values())])
            at = {s: ids[cuts[k] : cuts[k + 1]] for k, s in enumerate(held)}
            # sources without a term of this chunk are vectors of zeros
            dense = np.zeros((len(r["members"]), len(terms)), np.int64)
            for k, m in enumerate(r["members"]):
                if m["source"] in held:
                    dense[k, at[m["source"]]] = held[m["source"]]["n"]
            probs = np.stack([share(dense[k] + 2, m["own"] + 2 * m["kept"]) for k, m in enumerate(r["members"])])
            out = []
            for i, x in enumerate(r["members"]):
                for j, y in enumerate(r["members"]):
                    if x["source"] < y["source"] and (x["tile"] != y["tile"] or r["ta"] == r["tb"]):
                        some = (dense[i] > 0) | (dense[j] > 0)
                        out.append({"lang": r["lang"], "a": x["source"], "b": y["source"], "value": int(gap(probs[i], probs[j])[some].sum()), "present": int(some.sum())})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance from each other one of its language, and its most telling terms.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language
    keeps those that at least `least` of its documents hold. Null lang, source and text are
    empty; a document without terms still names its group; rows that repeat others count anew;
    other columns take no part; no document gives no row. Part `pair`: all others, by value,
    then name. Part `term`: of the terms that have a larger share here than in the language,
    the first `top`. Shares have two added to each count; all is in whole numbers.

    Nothing is broadcast but what Spark finds small: the dictionary stays in chunks, sources in
    tiles. A pair of sources meets chunk by chunk, and terms that neither has are one product.
    The result is a written table.
    """
    spark, ws = df.sparkSession, Workspace(df.sparkSession, "divergence")
    rows = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = rows.mapInArrow(tidy(counted), "lang string, source string, term string, n long, df long")
    counts = ws.save(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    sort = counts.repartitionByRange(partitions(spark), "lang", "term").sortWithinPartitions("lang", "term")
    kinds = "part int, chunk long, lang string, source string, ids array<int>, n array<long>, wide array<long>, terms array<string>"
    coded = ws.save(sort.mapInArrow(tidy(coder(least, CHUNK)), kinds), "coded")
    ws.drop("counts")

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    kept = coded.where("source is null").groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"))
    own = coded.where("source is not null").groupBy("lang", "source").agg(F.sum(total("n")).alias("own"))
    whole = own.groupBy("lang").agg(F.sum("own").alias("whole"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(kept.join(whole, "lang"), "lang", "left").na.fill(0, ["own", "kept", "whole"])
    # a source's tile is its place among its language's; sources of a language are the contract's square
    groups = ws.save(groups.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / TILE).cast("int")), "groups")

    vectors = coded.where("source is not null").drop("terms").join(groups, ["lang", "source"])
    best = vectors.select("lang", "source", "part", "chunk", "ids", "n", "wide", "own", "whole", "kept").mapInArrow(tidy(tops(top)), "lang string, source string, part int, chunk long, id int, value long")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "part", "chunk", "id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    words = coded.where("source is null").select("part", "chunk", "terms")
    best = best.join(words, ["part", "chunk"]).select("lang", "source", F.lit("term").alias("part"), F.get("terms", "id").alias("item"), "value", "rank")

    tiles = groups.groupBy("lang", "tile").agg(F.collect_list(F.struct("source", "tile", "own", "kept")).alias("m"))  # at most TILE
    meet = tiles.select("lang", F.col("tile").alias("ta"), F.col("m").alias("ma")).join(tiles.select("lang", F.col("tile").alias("tb"), F.col("m").alias("mb")), "lang").where("ta <= tb")
    meet = ws.save(meet.select("lang", "ta", "tb", F.when(F.col("ta") == F.col("tb"), F.col("ma")).otherwise(F.concat("ma", "mb")).alias("members")), "tiles")
    to = meet.select("lang", "ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile"))
    units = vectors.select("lang", "tile", "part", "chunk", F.struct("source", "ids", "n").alias("r")).join(to, ["lang", "tile"])
    units = units.groupBy("lang", "part", "chunk", "ta", "tb").agg(F.collect_list("r").alias("rows"))  # at most 2 * TILE rows of CHUNK terms
    found = units.join(meet, ["lang", "ta", "tb"]).select("lang", "ta", "tb", "rows", "members").mapInArrow(tidy(gaps), "lang string, a string, b string, value long, present long")
    found = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))

    # terms that neither has are one product
    pairs = meet.select("lang", "ta", "tb", "members", F.explode("members").alias("x")).select("lang", "ta", "tb", "x", F.explode("members").alias("y"))
    pairs = pairs.where("x.source < y.source and (x.tile <> y.tile or ta = tb)").select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.kept").alias("kept"), *(F.expr(f"1 + {2 * SCALE} div greatest({s}.own + 2 * {s}.kept, 1)").alias(c) for s, c in (("x", "p"), ("y", "q"))))
    pairs = pairs.join(found, ["lang", "a", "b"], "left").na.fill(0, ["value", "present"])
    pairs = pairs.select("lang", "a", "b", F.expr("value + (kept - present) * (((p - q) * (p - q)) div (p + q))").alias("value"))
    both = pairs.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return ws.result(both.unionByName(best))


#: The same rows by SQL, every group against every kept term.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM f),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - l.q) * (p.p - l.q) // (p.p + l.q) AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
both_ AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM both_ WHERE part = 'pair' OR rank <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
