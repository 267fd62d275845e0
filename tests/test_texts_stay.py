import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import windows
from palimpsest.operators import index
from palimpsest.sources import store as stored
from palimpsest.sources.store import Store, of_commits


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_changes_of_the_wanted_commits(spark, monkeypatch, most):
    monkeypatch.setattr(stored, "MOST_WORDS", most)
    rng = random.Random(3)
    numbers = [-(2**63), 2**63 - 1, -65, -64, -1, 0, 1, 62, 63, 64, 127, 128, 2**40 + 63, None, *(rng.randrange(-300, 300) for _ in range(200))]
    changes = spark.createDataFrame([(f"f{k % 5}", n, f"text {k}") for k, n in enumerate(numbers)], "path string, commit_index long, content string")
    wanted = {n for k, n in enumerate(numbers) if n is not None and n % 3} - {63}
    commits = spark.createDataFrame([(n,) for n in [*wanted, 10**6]], "commit_index long")
    got = sorted((r["content"], r["commit_index"]) for r in of_commits(changes, commits).collect())
    assert got == sorted((f"text {k}", n) for k, n in enumerate(numbers) if n in wanted)


def test_an_append_shuffles_no_text(spark):
    """Before, the texts were shuffled by commit to meet the new commits once these were too many for Spark's own broadcast."""
    changes = spark.range(3000).select(F.lit("f").alias("path"), F.col("id").alias("commit_index"), F.repeat(F.lit("long text "), 50).alias("content"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = of_commits(changes, spark.range(2900).select(F.col("id").alias("commit_index")))
        assert "BroadcastHashJoin" in plan_of(rows) and "SortMergeJoin" not in plan_of(rows)
        assert rows.count() == 2900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_append_without_news_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    rows = lambda *n: spark.createDataFrame([(k, f"c{k}", "f", f"text {k}") for k in n], "commit_index long, commit_id string, path string, content string")
    add = lambda *n: store.append(rows(*n).select("commit_index", "commit_id", F.timestamp_seconds("commit_index").alias("commit_time"), F.lit("").alias("summary")), rows(*n).select("path", "commit_index", "content"))
    assert add(0, 1) == 0 and add(1, 0) is None and store.batches() == [0]
    assert add(1, 2) == 1 and store.batches() == [0, 1] and store.head() == 2
    assert sorted(r["content"] for r in store.changes().collect()) == ["text 0", "text 1", "text 2"]


def test_tokens_are_shuffled_as_numbers(spark):
    """Before, each task gave a row of two strings for each pair, some 250,000 for 80 files."""
    texts = ["".join(chr(97 + (k * j) % 26) for j in range(400)) for k in range(1, 40)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(["f", "g", None] * 13), pa.array(texts)], ["path", "content"])])
    out = [tuple(r.values()) for b in windows.packed(batches()) for r in b.to_pylist()]
    assert len(out) == len({(p, k) for p, k, _ in out}) <= 3 << windows.PARTS_BITS
    want = {(p, t[j : j + 3]) for p, t in zip(["f", "g", None] * 13, texts) for j in range(398)}
    assert sorted((str(p), t) for p, _, b in out for t in windows.strings(np.frombuffer(b, "<u8"))) == sorted((str(p), t) for p, t in want)
    rows = spark.createDataFrame([(p, t) for p, t in zip(["f", "g", None] * 13, texts)] * 3, "path string, content string").repartition(7)
    got = [(r["path"], r["token"]) for r in index.postings(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_part_in_many_pieces_is_given_once(monkeypatch):
    monkeypatch.setattr(windows, "KEPT", 8)
    monkeypatch.setattr(windows, "GIVEN", 5)
    tokens = np.sort(windows.numbers("".join(map(chr, range(100, 140)))))
    some = [("f", 0, tokens[k % 5 : k % 5 + 20].tobytes()) for k in range(30)] + [("f", 3, tokens[:3].tobytes()), ("g", 3, tokens[:3].tobytes())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some[at : at + 7])], ["path", "part", "tokens"]) for at in range(0, len(some), 7)]
    got = [tuple(r.values()) for b in windows.unpacked(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted([(t, "f") for t in windows.strings(tokens[:24])] + [(t, p) for p in "fg" for t in windows.strings(tokens[:3])])
