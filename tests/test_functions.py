import pytest
from pyspark.sql import functions as F

from loomspark.functions import lines, missing, text, values


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()[0]


CASES = [
    ("مَرْحَبًا", text.strip_marks, "مرحبا"),
    ("مـــرحبا  يا", text.clean_light, "مرحبا يا"),
    ("a\t\tb\nc", text.clean_light, "a\t\tb\nc"),
    ("a\t\tb\nc", text.clean_hard, "a b c"),
    ("a ـ b", text.clean_hard, "a  b"),
    ("B a  A", text.token_signature, "a a b"),
    ("x l\ny l\nz l\nw k", lines.ending, "l"),
    ("x l\ny l\nz k", lines.ending, None),
    ("one", lines.ending, None),
    ("a\n\nb", lines.count_lines, 3),
    ("a\n\nb", lines.count_full_lines, 2),
    ("a\n\nb", lines.count_newlines, 2),
    ("a\nb\nc", lines.pair_lines, "a\tb"),
    ("a\nb\nc", lambda c: lines.pair_lines(c, "leave"), "a\nb\nc"),
    ("a\nb\nc", lambda c: lines.pair_lines(c, "pad"), "a\tb\nc\t"),
    ('["x","y","z"]', values.naturalize, "x، y، وz"),
    ("['x']", values.naturalize, "x"),
    ("[]", values.naturalize, ""),
    ("x", values.naturalize, "x"),
    ('["x","y"]', values.naturalize, "x، وy"),
    ("['it\\'s', \"a\"]", lambda c: values.naturalize(c, literals=True), "it's، وa"),
    ("البحر الطويل", values.normal_meter, "بحر الطويل"),
    ("الطويل", values.normal_meter, "بحر الطويل"),
    ("بحر nan", values.normal_meter, None),
    ("الحديث", values.normal_era, "العصر الحديث"),
    ("غير محدد", values.normal_era, None),
    ("عدد 12 بيت", values.first_integer, 12),
    ('```json {"a":1} ```', values.fenced, '{"a":1}'),
    ("3. text", text.strip_numbering, "text"),
    ("- • text", text.strip_bullets, "text"),
    ("a - b - c", text.before_dash, "a"),
    ("a b,c/d", text.safe_name, "a_b_c_d"),
    ("1\nsadr\najz\n2\nx\ny", lines.numbered_verses, ["sadr\tajz", "x\ty"]),
    ("\n".join("abcdefgh"), lines.repeats_lines, False),
    ("\n".join("abcdefga"), lines.repeats_lines, True),
    ("\n".join("abca"), lines.repeats_lines, False),
    ("a,b , c,d", lambda c: values.comma_parts(c, 4), ["a", "b", "c", "d"]),
    ("a,b", lambda c: values.comma_parts(c, 4), None),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(spark, k):
    value, f, want = CASES[k]
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("value", "want"), [(None, True), (" ", True), ("NaN", True), ("<NA>", True), ("[ ]", True), ("{}", True), ("Empty", True), ("x", False), ("0", False)])
def test_missing(spark, value, want):
    assert one(spark, value, missing.is_missing) is want


@pytest.mark.parametrize(("n", "percent", "cut"), [(10, 30, 3), (2, 10, 1), (2, 80, 1)])
def test_continuation(spark, n, percent, cut):
    body = "\n".join(map(str, range(n)))
    row = one(spark, body, lambda c: lines.continuation(c, F.lit(percent)))
    assert row["given"].count("\n") + 1 == cut
    assert row["given"] + "\n" + row["rest"] == body


def test_continuation_needs_two_lines(spark):
    assert one(spark, "only\n\n", lambda c: lines.continuation(c, F.lit(50))) is None


def test_template_key(spark):
    df = spark.createDataFrame([({"b": "1", "a": "2"}, {"o": "x"})], "i map<string,string>, o map<string,string>")
    assert df.select(values.template_key("i", "o")).first()[0] == "a__b___o"


@pytest.mark.parametrize(("value", "want"), [('{"k": "v"}', {"k": "v"}), ("['a','b']", {"a": "a", "b": "b"}), ("word", {"word": "word"}), (None, {"default": "unknown"}), ("", {"default": "unknown"})])
def test_parse_field(spark, value, want):
    assert one(spark, value, values.parse_field) == want


def test_tags(spark):
    df = spark.createDataFrame([(["قصائد حب", " بحر الكامل", "قافية الباء", "عموديه", "قصائد مدح"],), (None,)], "t array<string>")
    got = df.select(*(c.alias(n) for n, c in values.tag_classes("t").items())).collect()
    assert got[0].asDict() == {"genre": "قصائد مدح", "poem_type": "عموديه", "rhyme": "قافية الباء", "meter": "بحر الكامل"}
    assert set(got[1].asDict().values()) == {None}


def test_reply_items(spark):
    found = one(spark, '[{"id": "p1_r2", "corrupted_poem": "x"}]', values.reply_items)
    assert [(r["id"], r["corrupted_poem"]) for r in found] == [("p1_r2", "x")]
    found = one(spark, 'text {"id": "a", "corrupted_poem": "b"} and {"id": "c", "corrupted_poem": "d"}', values.reply_items)
    assert [r["id"] for r in found] == ["a", "c"]
    assert one(spark, "nothing", values.reply_items)[0]["corrupted_poem"] == "nothing"


def test_ids(spark):
    assert tuple(one(spark, "p3_r17", values.row_number_id)) == (3, 17)
    assert one(spark, "bad", values.row_number_id) is None


def test_display_names(spark):
    df = spark.createDataFrame([("meter__poet_name___poem_text",), (None,)], "k string")
    assert [r[0] for r in df.select(text.display_name("k")).collect()] == ["Meter, Poet Name → Poem Text", None]
