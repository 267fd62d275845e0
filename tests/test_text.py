import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("content, want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\r\nb\r", ["a", "b\r"]), ("\r\n", [""]), (None, None), ("a\n\nb", ["a", "", "b"])])
def test_lines(spark, content, want):
    assert one(spark, text.lines("c"), c=content) == want


def test_tokens_of_lines(spark):
    for line in ["", "a", "ab", "abc", "abcd", "a b c", "가나다라", "😀😀a😀", "\\x$.^"]:
        assert one(spark, text.line_tokens("c"), c=line) == text.literal_tokens(line)


def test_tokens_of_random_texts(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab\n\r가😀") for _ in range(rng.randrange(40))),) for _ in range(300)]
    got = spark.createDataFrame(rows, "c string").select("c", text.tokens("c").alias("t"), F.array_distinct(F.flatten(F.transform(text.lines("c"), text.line_tokens))).alias("u")).collect()
    for r in got:
        assert set(r["t"]) == set(r["u"]) and len(r["t"]) == len(set(r["t"])), r["c"]


def test_highlight_and_shorten(spark):
    assert text.marked("this is a line", [("is", 5)], "<", ">") == "this <is> a line"
    assert text.marked("this is a line", [("a", 8), ("is", 5)], "<", ">") == "this <is> <a> line"
    assert text.marked("가나 is", [("is", 7)], "<", ">") == "가나 <is>"
    long = "가" * 50 + "나" * 50
    assert text.short(long) == "가" * 40 + " ... " + "나" * 40
    assert one(spark, text.shortened("c"), c=long) == text.short(long)
    assert one(spark, text.shortened("c"), c="x" * 79) == "x" * 79
    assert one(spark, text.shortened("c"), c="가나a다") == "가나a다"
    assert one(spark, text.highlighted("c", ["is", "a"], "<", ">"), c="is it a$") == "<is> it <a>$"


def test_labels(spark):
    assert one(spark, text.numbered("n"), n=7) == "     7| "
    assert one(spark, text.numbered("n"), n=12345678) == "12345678| "
    at = F.to_timestamp(F.lit("2024-01-31 12:30:00"))
    assert one(spark, text.commit_label(F.col("c"), at, F.lit(False)), c="0123456789ab") == "01234567 (at 2024-01-31 12:30)"
    assert one(spark, text.commit_label(F.col("c"), at, F.lit(True)), c="0123456789ab") == "HEAD (at 2024-01-31 12:30)"
    assert one(spark, text.seen_text(F.col("a"), F.col("b")), a="x", b=None) == "First seen at x, never seen afterwards"


def test_queries_are_read():
    assert text.query_of("q: foo bar ") == ("plain", "foo bar")
    assert text.query_of("r:fo+") == ("regex", "fo+") and text.query_of("fo+") == ("regex", "fo+")
    assert text.words_of(" foo  bar foo ") == ["foo", "bar"]


def test_leftmost_first(spark):
    assert one(spark, text.found_words("c", ["foo", "foobar", "abc", "bcd"]), c="foobar abcd") == ["abc", "foo"]
