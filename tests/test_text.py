import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from captionloom.functions import text
from captionloom.functions.text import clamp_text, clean_caption, first_truthy
from captionloom.operators import filters


def expected(text):
    text = re.sub(r"<[^>]+>", " ", html.unescape(text or ""))
    return re.sub(r"\s+", " ", text).strip().lower()


CASES = [
    (None, ""),
    ("  A  <b>Red</b>\tFox ", "a red fox"),
    ("&lt;b&gt;Hi&lt;/b&gt;", "hi"),
    ("&amp;lt;x", "&lt;x"),
    ("a < b > c", "a c"),
    ("<>x", "<>x"),
    ("caf&eacute;&nbsp;NOIR", "café noir"),
    ("a\x1cb", "a b"),
    ("&notit; &#65;&#x42 &unknown; &", None),
    ("x 　y\x85 z &#0; &#128; &amp", None),
    ("multi\nline <a\nhref='x'>tag</a>", None),
]


def clean(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in rows.select("i", clean_caption("t").alias("c")).orderBy("i").collect()]


def test_clean_caption_cases(spark):
    got = clean(spark, [c for c, _ in CASES])
    assert got == [expected(c) for c, _ in CASES]
    assert all(g == w for g, (_, w) in zip(got, CASES) if w is not None)


def test_clean_caption_equals_python(spark):
    pieces = st.sampled_from(
        ["&", "&amp;", "&lt", "&#", "65;", "<", ">", " ", "\t", "\xa0", " ", " ", "é", "A", "&copy", ";", "x", "<i>"]
    )

    @settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.lists(pieces, max_size=12).map("".join), min_size=80, max_size=120))
    def check(texts):
        assert clean(spark, texts) == [expected(t) for t in texts]

    check()


def test_clean_caption_is_evaluated_once(spark):
    rows = spark.range(3).select(clean_caption(F.col("id").cast("string")).alias("c")).filter("c <> ''")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_first_truthy(spark):
    rows = spark.createDataFrame([("", "b"), (" ", "b"), (None, None)], "TEXT string, text string")
    got = [r[0] for r in rows.select(first_truthy(rows, "TEXT", "text", "caption")).collect()]
    assert got == ["b", " ", None]


def test_clamp_counts_code_points(spark):
    row = spark.createDataFrame([("a😀b c",)], "t string").select(clamp_text("t", 4)).first()
    assert row[0] == "a😀b "


@pytest.mark.parametrize(
    "flag, safe",
    [("NSFW", False), ("Unsafe", False), ("porn", False), ("sexual", False), ("1", False), ("UNLIKELY", True),
     ("UNSURE", True), ("", True), ("0", True), ("true", True), (None, True)],
)
def test_is_safe(spark, flag, safe):
    for name in ("NSFW", "nsfw"):
        rows = spark.createDataFrame([(flag,)], f"{name} string")
        assert rows.select(filters.is_safe(rows)).first()[0] is safe


def test_present_flag_decides(spark):
    rows = spark.createDataFrame([(None, "porn")], "NSFW string, nsfw string")
    assert rows.select(filters.is_safe(rows)).first()[0] is True
    absent = spark.createDataFrame([(1,)], "x int")
    assert absent.select(filters.is_safe(absent)).first()[0] is True


def test_reasons_and_filter_agree(spark):
    rows = spark.createDataFrame(
        [("u", "A b", None), ("", "A", None), (None, "A", None), ("u", "<b> </b>", "x"), ("u", "A", "NSFW"), ("u", "", "porn")],
        "URL string, TEXT string, NSFW string",
    )
    reasons = [r.reason for r in filters.with_reason(rows).collect()]
    assert reasons == ["kept", "no_url", "no_url", "no_caption", "unsafe", "unsafe"]
    assert [tuple(r) for r in filters.safe_captions(rows).collect()] == [("u", "a b")]


def test_limit_input_zero_keeps_all(spark):
    rows = spark.range(5).withColumnRenamed("id", "idx")
    assert filters.limit_input(rows, 0).count() == filters.limit_input(rows, None).count() == 5
    assert filters.limit_input(rows, 2).count() == 2


def test_every_kind_of_space_and_no_other_character_is_one(spark):
    marks = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(ord(c), f"a{c}b", f"a {c}b", f"a{c} b") for c in marks], "n int, lone string, after string, before string")
    clean = rows.select("n", *[F.regexp_replace(c, text.WHITESPACE, "_").alias(c) for c in ("lone", "after", "before")])
    for n, *got in clean.collect():
        c = chr(n)
        if c == " ":
            assert got == ["a b", "a_b", "a_b"]
        else:
            assert got == (["a_b"] * 3 if c.isspace() else [f"a{c}b", f"a {c}b", f"a{c} b"]), hex(n)
