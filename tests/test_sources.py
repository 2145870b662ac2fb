import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from loomspark.operators import templates
from loomspark.sources import html, readers, unify, writers
from loomspark.streaming import events


def test_delimited_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline\t2', "x"), (2, "plain", None)]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    for sep, ending in ((",", "csv"), ("\t", "tsv")):
        path = f"{tmp_path}/out.{ending}"
        writers.delimited(df, path, sep)
        got = readers.load(spark, path).orderBy("id").collect()
        assert [(r.id, r.t, r.u) for r in got] == rows


def test_tolerant(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("a\tb\n1\t2\n1\t2\t3\n4\t5\n")
    assert readers.delimited(spark, str(path), "\t", tolerant=True, schema="a int, b int").count() == 2
    with pytest.raises(ValueError):
        readers.load(spark, "x.doc")


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("q", "r", 9000, "train", "t1"), ("q2", None, 7999, "test", "t2")], "input string, output string, num_tokens long, split string, task string")
    writers.instructions(df, f"{tmp_path}/i")
    got = spark.read.json(f"{tmp_path}/i").orderBy("instruction").collect()
    assert [(r.instruction, r.input, r.output) for r in got] == [("q", "", "r"), ("q2", "", None)]
    writers.by_context(df, f"{tmp_path}/c")
    assert sorted(os.listdir(tmp_path / "c"))[-2:] == ["context=LongContext", "context=ShortContext"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert readers.load(spark, f"{tmp_path}/bad.jsonl", schema="a int").count() == 2
    writers.json_array(spark.range(20), f"{tmp_path}/array")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "array").glob("part-*"))) == [{"id": k} for k in range(20)]
    writers.json_array(spark.range(0), f"{tmp_path}/array")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "array").glob("part-*"))) == []
    assert "1,234" in writers.latex_table(spark.range(1234, 1235))


def test_stats_round_trip(spark, tmp_path):
    t, d = spark.createDataFrame([("a__b", 3), ("c", 5)], "key string, n long"), spark.createDataFrame([("msa", 8)], "key string, n long")
    path = tmp_path / "s.txt"
    path.write_text(writers.stats_text(t, d))
    assert {tuple(r) for r in templates.stats_lines(spark, str(path)).collect()} == {("Template", "a__b", 3), ("Template", "c", 5), ("Dialect", "msa", 8)}


def test_files(spark, tmp_path):
    for part in ("love/abbasid/a_b_title.txt", "love/abbasid/nounderscore.txt"):
        path = tmp_path / "p" / part
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("line 1\nline 2")
    got = readers.titled_files(spark, f"{tmp_path}/p").collect()
    assert [tuple(r) for r in got] == [("love", "abbasid", "a_b", "title", "line 1\nline 2")]
    for n in ("one", "two"):
        (tmp_path / "d" / n).mkdir(parents=True)
        (tmp_path / "d" / n / "x.csv").write_text("a\n1\n")
    assert {r.dataset_name for r in readers.datasets(spark, f"{tmp_path}/d").collect()} == {"one", "two"}


def test_cached(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.cached(spark, f"file://{tmp_path}/c", build, "random", "chat").count() == 3
    assert len(calls) == 1


PAGE = """<html lang="ar"><head><title>T - P - site</title><link rel="canonical" href="u">
<script type="application/ld+json">{"itemListElement": [{"position": 1, "name": "era", "item": "e"}, {"position": 2, "name": "p", "item": "x/cat-poet-1"}, {"position": 3, "name": "Title", "item": "t"}]}</script></head>
<body><script>no</script><h3>a</h3><h3>b</h3><h3>c</h3><div class="tips"><a>t1</a><a> t2 </a></div><p>one &amp; two</p></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "id long, html string")
    got = {r.id: r for r in html.extract(df, keep=("id",)).collect()}
    r = got[1]
    assert (r.title, r.poet, r.era, r.poem_url, r.poet_page_url, r.poem, r.tags) == ("Title", "P", "era", "u", "x/cat-poet-1", "a\tb\nc\t", ["t1", "t2"])
    assert "one & two" in r.text and "no" not in r.text.split()
    assert got[2].poem is None and got[3].tags == []
    row = df.where("id = 1").select(html.title("html"), html.language("html"), html.breadcrumbs("html")).first()
    assert row[0] == "T - P - site" and row[1] == "ar" and row[2][1]["url"] == "x/cat-poet-1"


def test_unify(spark):
    arapoems = spark.createDataFrame([(2, "T", "P", "Modern", "c", "d"), (1, "T", "P", "Modern", "a", None)], "pos int, poem_title string, poet string, era string, first_hemistich string, second_hemistich string")
    row = unify.grouped_lines(arapoems).first()
    assert row.poem_text == "a\t\nc\td" and row.poet_era == "العصر الحديث"
    q = spark.createDataFrame([('"a" "b" "c" "d"\nnone\n"e" "f"', "[{'text': 'x'}, {'text': 'y'}"), (" ".join(['"a"'] * 9), None)], "`poem verses` string, `poem description` string")
    a, b = unify.quoted_poems(q).collect()
    assert a.poem_text == "a b\tc d\ne\tf" and a.overall_explanation == "x y" and b.poem_text is None
    n = spark.createDataFrame([("1\na\nb\n2\nc\nd", "['m','g','e']", "2"), ("1\na\nb", "['m']", "1")], "poem_verses string, tags string, verse_count string")
    got = unify.numbered_poems(n, strict=True).collect()
    assert [(r.poem_text, r.meter, r.valid) for r in got] == [("a\tb\nc\td", "m", True), ("a\tb", None, False)]
    c = spark.createDataFrame([("a\nb\nc\nd\ne", "g, t, m, r", "2 verses"), ("a\nb", "g", "7")], "poem_text string, poem_tags string, poem_count string")
    got = unify.counted_poems(c).collect()
    assert [(r.poem_text, r.genre, r.rhyme) for r in got] == [("a\tb\nc\td", "g", "r")]
    s = spark.createDataFrame([("adab", "t", "a\n\n\tb", "x", ["بحر س"], "مصر", "p", "1", "u"), ("diwan", "t - s", "z", "x", None, ">", "p", "2", "u")], "source string, title string, poem string, poem_no_diacritics string, tags array<string>, era string, poet string, id string, poet_page_url string")
    got = unify.scraped_poems(s).collect()
    assert [(r.poem_text, r.location, r.poet_era, r.meter) for r in got] == [("a\nb", "مصر", None, "بحر س")]
    union, unknown = unify.unify_all({"AraPoems": arapoems, "scraped_poems": s, "what": s})
    assert unknown == ["what"] and sorted(r.poem_id for r in union.collect()) == [1, 2]
    e = spark.createDataFrame([("مصر", "", "البحر الطويل"), ("الحديث", "x", None)], "poet_era string, location string, meter string")
    got = unify.normalise_eras(e).collect()
    assert [tuple(r) for r in got] == [(None, "مصر", "بحر الطويل"), ("العصر الحديث", "x", None)]
    assert unify.valued_columns(e.withColumn("g", F.lit(1)), "g", 1) == ["poet_era", "location", "meter"]


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string").write.parquet(src)
    for _ in range(2):
        events.enrich_stream(events.source(spark, src), lambda df: df.withColumn("r", F.upper("p")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {r.r for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"A", "B"}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:10:00' AS ts, 1L AS user, 2.0D AS value UNION ALL SELECT timestamp '2024-01-01 00:20:00', 1L, 3.0D")
    assert [(r.n, r.total) for r in events.windowed(rows, "ts", "value").collect()] == [(2, 5.0)]
    assert [r.n for r in events.sessions(rows, "ts", "user").collect()] == [2]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a <b> & "c"', 2.5), (2, None, None), (3, "  spaced ", 0.0)], "Id int, Text string, Score double")
    writers.sheet(df, f"{tmp_path}/x.xlsx", "Blätter", widths=[5, 40, 8])
    got = readers.load(spark, f"{tmp_path}/x.xlsx")
    assert got.columns == ["id", "text", "score"]
    assert [tuple(r) for r in got.collect()] == [("1", 'a <b> & "c"', "2.5"), ("2", None, None), ("3", "  spaced ", "0.0")]
    assert readers.sheet(spark, f"{tmp_path}/x.xlsx", "Blätter").count() == 3
    with pytest.raises(ValueError):
        readers.sheet(spark, f"{tmp_path}/x.xlsx", "none")


def test_yaml_templates(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text("msa:\n- {id: 1, input: [a, b], output: [c], text: [one, two]}\ngulf:\n- {id: x, input: [a], output: c, text: [three]}\n")
    got = {tuple(map(str, r)) for r in readers.yaml_templates(spark, f"{tmp_path}/t.yaml").collect()}
    assert got == {("msa", "1", "['a', 'b']", "c", "one"), ("msa", "1", "['a', 'b']", "c", "two"), ("gulf", "x", "['a']", "c", "three")}


def test_hub_reads_a_cache(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/org/set/train")
    for p in (tmp_path / "org/set/train").glob("part-*.parquet"):
        p.rename(p.with_name(f"train-{p.name}"))
    assert readers.hub(spark, "org/set", cache=str(tmp_path)).count() == 3
    with pytest.raises(RuntimeError):
        readers.hub(spark, "org/set")


def test_fetched_pages(spark):
    def get(url):
        n = int(url.rsplit("/", 1)[1])
        if n == 3:
            raise OSError("down")
        return (404, None) if n == 2 else (500, "x") if n == 4 else (200, f"page {n}")

    todo = readers.work_list(spark, 1, 5, spark.createDataFrame([(5,)], "id long"))
    got = {r.id: (r.status, r.body) for r in readers.fetched(todo, "http://x/{id}", get, tries=2, wait=0).collect()}
    assert got == {1: (200, "page 1"), 2: (404, None), 3: (-1, None), 4: (-1, None)}


def test_html_files_are_sorted_and_checked(spark, tmp_path):
    for n in "cab":
        (tmp_path / f"{n}.html").write_text(PAGE)
    files = readers.html_files(spark, f"{tmp_path}")
    assert [r.path[-6:] for r in files.collect()] == ["a.html", "b.html", "c.html"]
    records = html.extract(files, "html", ("path",))
    assert html.checked(records, 3).count() == 3
    with pytest.raises(ValueError):
        html.checked(records, 4)
    with pytest.raises(ValueError):
        html.checked(records.withColumn("title", F.lit("<b>x</b>")))


def test_keys_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("a, b/c", 1), ("d", 2)], "k string, n int")
    writers.by_key(df, f"{tmp_path}/k", "k")
    assert {d for d in os.listdir(tmp_path / "k") if "=" in d} == {"template_key=a__b_c", "template_key=d"}
    one, two = (writers.versioned(df, f"{tmp_path}/v") for _ in range(2))
    assert one != two and spark.read.parquet(one).count() == 2
    assert writers.with_predictions("a/b.tsv") == "a/b_with_predictions.tsv" and writers.with_predictions("a.b/c") == "a.b/c_with_predictions"
    calls = []
    build = lambda: calls.append(1) or spark.range(2)
    for force in (False, True):
        writers.cached(spark, f"file://{tmp_path}/f", build, force=force)
    assert len(calls) == 2


def test_layouts_by_own_keys(spark):
    rows = spark.createDataFrame([("t", "p", "شعر", "o", "g", "n")], "poem_name string, poet_name string, poem string, era string, genre string, x string")
    out, unknown = unify.unify_all({"mine": rows, "other": rows}, {"mine": "filed_poems"})
    assert unknown == ["other"] and [r.dataset_name for r in out.collect()] == ["mine"] and out.first().poem_id == 1


@pytest.mark.parametrize("mark_up", ["<p>x", "<div>x", "<div class=tips><a>x", "<h3>x<div>", "<span>x", "<li><b>x", "</div></p>x", "<a><p>x</b>"])
def test_unclosed_elements_in_any_number(mark_up):
    got = html.record_of("<title>t - p - s</title>" + mark_up * 100_000)
    assert (got["title"], got["poet"], got["text"].count("x")) == ("t", "p", 100_000)
    assert len(got["tags"]) == (100_000 if "tips" in mark_up else 0) and set(got["tags"]) <= {"x"}


def test_implied_ends():
    page = "<div class=tips><a>one<a>two</div><a>three</a><h4>a<br>b<script type='application/ld+json'>{\"itemListElement\": [{\"name\": \"era\", \"item\": \"u\"}]}</script><p>c<p>d"
    got = html.record_of(page)
    assert got["tags"] == ["one", "two"] and got["era"] == "era" and got["poem"] == "a\nb\nc\nd" and got["text"] == "onetwo\nthree\na\nb\nc\nd"
    assert html.record_of("<h3>x<h3>y</h3><h3>z")["poem"] == "x\ty\nz\t"
    assert html.record_of(None)["text"] == "" and html.record_of("<span>a<span>id@</span></span>")["poet_english_id"] == "aid@"


def test_a_file_for_each_page_needs_no_folder_for_each(spark, tmp_path):
    from loomspark.operators.scratch import workspace
    from loomspark.plans import catalog, files  # noqa: F401

    rows = [(k, f"<p>é{k}\r\nx</p>") for k in range(50)] + [(7, "<p>again</p>"), (7, "<p>again</p>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with workspace(spark) as at:
        got = sorted(map(tuple, catalog.QUERIES["page_files"](spark, f"{tmp_path}").collect()))
        made = [d for d, _, own in os.walk(at.removeprefix("file://")) if any(f.endswith(".html") for f in own)]
    assert got == sorted((k, hashlib.md5(h.replace("\r\n", " ").encode() + b"\n").hexdigest()) for k, h in rows)
    assert len(made) == 1


def test_a_file_for_each_row_in_other_stores(spark, tmp_path):
    from loomspark.sources import named

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pages.link./in", f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (2, "b")], "k long, t string")
    for root in ("viewfs://pages/in/far", f"file://{tmp_path}/near"):
        named.file_per_row(df, "k", "t", root)
        got = [(r.path.rsplit("/", 1)[1], r.html) for r in readers.html_files(spark, root).collect()]
        assert got == [("1.html", "a\n"), ("2.html", "\n"), ("2~2.html", "b\n"), ("null.html", "c\n")]
