from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.sources.store import Store


def test_the_stored_index_makes_no_string_for_each_window(spark, tmp_path, monkeypatch):
    """Before, an append cut every version into strings by text.tokens() and exploded them."""
    rows = [(k, f"{k}", "g" if k == 2 else "f", ["abcd\nx", "abcd\r\nxy", None, "bcdé"][k]) for k in range(4)]
    docs = spark.createDataFrame(rows, "commit_index long, commit_id string, path string, content string")
    want = {tuple(r) for r in docs.where("content is not null").select(F.explode(text.tokens("content")), "path").collect()}
    monkeypatch.setattr(text, "tokens", None)
    store = Store(spark, f"file://{tmp_path}/index")
    for part in ("commit_index < 2", "commit_index >= 2"):
        store.append(docs.where(part).select("commit_index", "commit_id", F.timestamp_seconds("commit_index").alias("commit_time"), F.lit("").alias("summary")), docs.where(part).select("path", "commit_index", "content"))
    assert {tuple(r) for r in store.postings().collect()} == want
    assert {tuple(r) for r in store.postings(["bcd", "x"]).collect()} == {("bcd", "f"), ("x", "f")}
