import random

import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.functions import text, windows
from palimpsest.operators import index

ODD = ["", "\n", "a", "ab", "abc", "abcd\r\n\r\nxy\r\nz", "a\rb\n\rc\r", "\r\n", "x\n\ny", "\U0001f600\U0001f601\n\U0001f602\U0001f603\U0001f604\U0001f605", "\0\0\0\n\0", "\U0010ffff\U0010ffff\U0010ffff", "éür", "ab\r", "\ncd", "tail\n"]


def test_numbers_are_read_back():
    assert sorted(windows.strings(windows.numbers("abcd\n\0\nxy\n\U0010ffffz\n"))) == sorted(["abc", "bcd", "\0", "xy", "\U0010ffffz"])
    assert windows.strings(windows.numbers("")) == []


def test_slices_meet(monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcde\n") for _ in range(3000))
    whole = sorted(windows.strings(windows.numbers(long)))
    monkeypatch.setattr(windows, "SLICE", 7)
    assert sorted(windows.strings(windows.numbers(long))) == whole


def test_as_the_expression(spark):
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choice("aü\r\n\n\U0001f600b") for _ in range(rng.randrange(40))) for _ in range(200))]
    raw = [t.encode() for t in texts] + [b"ab\xffcd\xed\xa0\x80e\xe2\x82\nf\xf0\x9f", b"\xc3\n\xc3\xa9\xff"]
    rows = spark.createDataFrame([(f"p{k % 7}", k, bytearray(b)) for k, b in enumerate(raw)] + [("gone", 9, None)], "path string, commit_index long, b binary").select("path", "commit_index", F.expr("cast(b as string)").alias("content"))
    want = {(r["path"], r["commit_index"], r["token"]) for r in rows.where("content is not null").select("path", "commit_index", F.explode(text.tokens("content")).alias("token")).collect()}
    got = [tuple(r) for r in index.version_tokens(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = [tuple(r) for r in index.postings(rows).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(t, p) for p, _, t in want}


def test_a_task_gives_a_pair_once_and_holds_little(monkeypatch):
    """Before, every version gave its tokens anew: 300 times the pairs here."""
    batches = [pa.RecordBatch.from_arrays([pa.array(["f", "g"] * 50), pa.array(["abcd\nx", "abcé"] * 50)], ["path", "content"]) for _ in range(3)]
    rows = lambda: [tuple(r.values()) for b in windows.pairs(iter(batches)) for r in b.to_pylist()]
    once = rows()
    assert sorted(once) == sorted([("abc", "f"), ("bcd", "f"), ("x", "f"), ("abc", "g"), ("bcé", "g")])
    monkeypatch.setattr(windows, "WAITING", 20)
    assert sorted(rows()) == sorted(once)
    monkeypatch.setattr(windows, "KEPT", 4)
    assert len(rows()) > len(once) and set(rows()) == set(once)


def test_postings_make_no_row_for_each_window(spark):
    h = spark.createDataFrame([("f", 1, "abc")], "path string, commit_index long, content string")
    for rows in (index.postings(h), index.version_tokens(h)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
