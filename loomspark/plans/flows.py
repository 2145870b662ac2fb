"""Queries of streams with state, crawls, sinks with names, stored states, and labels by a real tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chat, known, replies, sketches
from ..sources import crawl, named
from ..streaming import events, retries
from . import sql as S
from .catalog import query
from .files import place


def busy(prompts: list[str], tries: list[int]) -> list:
    """A service that fails as often as a prompt's number has it, then answers."""
    return [p.upper() if t > int(p.split()[0]) % 4 else RuntimeError("busy") for p, t in zip(prompts, tries, strict=True)]


@query("""
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN upper(event_id || ' ' || event_type) END AS reply, CAST(least(event_id % 4 + 1, 3) AS INTEGER) AS attempts,
  CASE WHEN event_id % 4 = 3 THEN 'busy' END AS error FROM events
""")
def retried_events(t):
    """Every event is a request; some fail once, twice, or three times, which is once too often."""
    rows = events.source(t.spark, f"{t.sf_dir}/events.parquet").withColumn("prompt", F.concat(F.col("event_id").cast("string"), F.lit(" "), "event_type"))
    stream = retries.retried(rows, "event_id", "prompt", "ts", busy, attempts=3, delay=0.2, lanes=8)
    path = place(t, "answers")
    got = retries.drained(stream, f"{path}/out", f"{path}/checkpoint", trigger="200 milliseconds")
    return got.select(F.col("id").cast("long").alias("event_id"), "reply", "attempts", "error")


def page_of(page: int, attempt: int) -> str | None:
    """A site that has no page for every seventh id, and fails at times."""
    if attempt <= page % 3:
        raise TimeoutError(f"no answer for {page}")
    return None if page % 7 == 0 else f"page {page}"


@query("""
SELECT id, CASE WHEN id % 7 <> 0 THEN 'page ' || id END AS body, CAST(id % 3 + 1 AS INTEGER) AS attempts, CAST(NULL AS VARCHAR) AS error, page_id IS NOT NULL AS listed
FROM (SELECT unnest(range((SELECT max(page_id) + 6 FROM pages))) AS id) LEFT JOIN (SELECT DISTINCT page_id FROM pages) ON page_id = id
""")
def crawled_pages(t):
    """The ids up to some beyond the last page's, in two runs over one checkpoint: the first stops before its time."""
    path, last = place(t, "crawl"), t.pages.agg(F.max("page_id")).first()[0] + 5
    run = lambda patience: crawl.crawl(t.spark, page_of, 0, last, f"{path}/out", f"{path}/checkpoint", per_batch=last // 3 + 1, attempts=4, delay=0.2, lanes=8, patience=patience)
    run(4.0)
    got = run(3600.0)
    return got.join(t.pages.select(F.col("page_id").alias("id")).distinct().withColumn("listed", F.lit(True)), "id", "left").na.fill(False, ["listed"])


@query("SELECT doc_id, regexp_replace(source || '/' || lang || ', x', '[ ,/]', '_', 'g') || '.jsonl' AS file FROM documents")
def named_files(t):
    """A file for each key, by its name."""
    path = place(t, "named")
    named.file_per_key(t.documents.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit(", x")).alias("k")), "k", path)
    rows = t.spark.read.schema("doc_id long").json(f"{path}/*.jsonl")
    return rows.select("doc_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def conversation_labels(t):
    """The ids of whole conversations; what the assistant says is learnt."""
    rows = chat.labelled(chat.messages(t.conversations, "conv_id", "turn", "role", "text"), "messages", public_tokenizer())
    return rows.select("conv_id", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x != chat.IGNORED)).alias("n_learnt"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@query()
def token_budget_ids(t):
    """Texts within 64 ids."""
    rows = chat.within_budget(t.documents.select("doc_id", "text"), "text", public_tokenizer(), longest=200, new_tokens=100, margin=36)
    return rows.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query("""
SELECT doc_id, item, CASE item WHEN 1 THEN '{"id":' || doc_id || ',"lang":"' || lang || ' {\\"}"}' ELSE '{"n":' || length(source) || '}' END AS value, CAST(NULL AS VARCHAR) AS error
FROM documents, (VALUES (1), (2)) v(item) WHERE item = 1 OR doc_id % 5 <> 0
UNION ALL SELECT doc_id, 2, '{"n": ', 'cut off' FROM documents WHERE doc_id % 5 = 0
""")
def replies_in_pieces(t):
    """Replies of two objects in pieces of seven characters; of every fifth the end is lost."""
    one = F.concat(F.lit('say {"lang": "'), "lang", F.lit(' {\\"}", "id": '), F.col("doc_id").cast("string"), F.lit("} and"))
    two = F.when(F.col("doc_id") % 5 == 0, F.lit('{"n": ')).otherwise(F.concat(F.lit('{"n": '), F.length("source").cast("string"), F.lit("}.")))
    rows = t.documents.select("doc_id", F.concat(one, two).alias("r"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("r") - 1) / 7).cast("int"))).alias("place")
    rows = rows.select("doc_id", "r", at).select("doc_id", "place", F.substr("r", F.col("place") * 7 + 1, F.lit(7)).alias("piece"))
    return replies.assembled(rows, "doc_id", "place", "piece").select(F.col("reply").cast("long").alias("doc_id"), "item", "value", "error")


@query("SELECT source, count(*) AS rows, TRUE AS texts_close, TRUE AS median_close FROM documents GROUP BY source")
def stored_sketches(t):
    """Two loads are stored; what their states tell together is held against exact statistics."""
    path = place(t, "sketches")
    for load in range(2):
        own = t.documents.where(F.col("doc_id") % 2 == load)
        sketches.store(sketches.states(own, ["source"], {"texts": F.md5("text")}, {"chars": F.length("text").cast("long")}), path, str(load))
    got = sketches.united(t.spark, path, ["source"])
    exact = t.documents.groupBy("source").agg(F.countDistinct(F.md5("text")).alias("n"), F.percentile(F.length("text"), F.lit([0.45, 0.55])).alias("p"))
    close = (F.abs(F.col("distinct_texts") - F.col("n")) <= 0.03 * F.col("n")).alias("texts_close")
    median = F.col("quantiles_chars")[1].between(F.floor(F.col("p")[0]), F.ceil(F.col("p")[1])).alias("median_close")
    return got.join(exact, "source").select("source", "rows", close, median)


@query(f"""
WITH d AS (SELECT doc_id, {S.hard('text')} AS t, doc_id % 3 AS load FROM documents), f AS (SELECT t, min(load) AS load FROM d GROUP BY t)
SELECT min(doc_id) AS doc_id FROM d JOIN f USING (t, load) GROUP BY t
""")
def incremental_dedup(t):
    """Three loads; each keeps the first of every text that no load before had."""
    index = known.Index(t.spark, place(t, "known"), buckets=max(64, int(t.spark.conf.get("spark.sql.shuffle.partitions"))))
    out = None
    for load in range(3):
        new = index.add(t.documents.where(F.col("doc_id") % 3 == load), "doc_id", text.clean_hard("text")).select("doc_id")
        out = new if out is None else out.unionByName(new)
    return out
