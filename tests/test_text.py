import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.index import tokens_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "term", "hit"),
    [
        ("öl", "öl", True), ("öle", "öl", True), ("ölkanne", "öl", False),  # three bytes: prefix, two bytes more at most
        ("ok", "ok", True), ("oks", "ok", False), ("amrs", "amr", True), ("wired", "red", False), ("reduced", "red", False), ("reds", "red", True),
        ("charging", "charfing", True), ("discharge", "charge", True), ("sensor", "sensr", True), ("snor", "sensr", False), ("emergency", "emergancy", True), ("größe", "grösse", False),
        ("2026", "2", False), ("2", "2", True),
    ],
)
def test_matches_by_bytes(spark, word, term, hit):
    assert one(spark, T.matches(F.lit(word), F.lit(term))) is hit


def test_typo_bounds(spark):
    near = lambda a, b: one(spark, T.within_typo(F.lit(a), F.lit(b)))
    assert near("abcd", "abcx") and not near("abc", "abx")  # under four bytes none
    assert near("abcdefg", "abcdefx") and not near("abcdefg", "abcdxyx")  # up to seven bytes one edit
    assert near("abcdefgh", "abcdefxy") and not near("abcdefgh", "abcdexyz")


def test_query_terms():
    assert T.query_terms("The Öl-Sensor, and the sensor?") == ["öl", "sensor", "sensor"]
    assert T.query_terms("what is it") == [] and T.query_terms("") == [] and T.query_terms("2.2.9") == ["2", "2", "9"]
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS))


def test_lines_and_slugs(spark):
    assert one(spark, T.normal_line(F.lit(" A  b\t C "))) == "a b c"
    assert one(spark, T.is_page_marker(F.lit("page 3 of 10"))) and one(spark, T.is_page_marker(F.lit("page 3")))
    assert not one(spark, T.is_page_marker(F.lit("page three"))) and not one(spark, T.is_page_marker(F.lit("see page 3")))
    assert one(spark, T.slug(F.lit("My File (v1.0)"))) == "my-file-v10"
    assert [r["x"] for r in spark.createDataFrame([(" 3-8",), ("x",), (None,), ("7",)], "p string").select(T.pages_start("p").alias("x")).collect()] == [3, None, None, 7]


def test_kind(spark):
    kinds = {"a/b.PDF": "pdf", "x.docx": "office", "x.ppt": "office", "x.TXT": "text", "x.html": None, "pdf": None, "a.pdf/x": None}
    for path, kind in kinds.items():
        assert one(spark, T.kind_of(F.lit(path))) == kind


def test_tokens_and_bytes():
    assert tokens_of("Öl, naïve x_y İ") == [(0, "öl"), (5, "naïve"), (12, "x"), (14, "y"), (16, "i̇")]
    assert tokens_of("") == [] and tokens_of("—!") == []
    text = "ß" * 5000 + " end"
    assert tokens_of(text)[1] == (10001, "end")


def test_safe_name():
    assert T.safe_name("a-b") and not any(map(T.safe_name, ("", "a/b", "..", "a\\b")))
