import importlib

from palimpsest.llm import decontam, langid, linededup, minhash
from tests.llm import helpers


def test_stages_and_run_agree(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.written(stage(spark, docs, sf), "test")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        had = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= had and len(ids) > 0.6 * len(had), name
        if name != "mix_sources":
            assert docs.columns == columns
        if name == "near_dedup":
            assert ids == had - {r["doc_id"] for r in minhash.near_duplicates(before).collect()}
        if name == "decontaminate":
            hit = {r["doc_id"] for r in decontam.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert hit and ids == had - hit
        if name == "language_id":
            assert ids == {r["doc_id"] for r in langid.identify(before).collect() if r["keep"]}
        if name == "line_dedup":
            cut = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(before).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: t for i, t in cut.items() if i in ids}
            assert all(not cut[i].strip() for i in had - ids)
    whole = {(r["doc_id"], r["slot"], r["nth"]) for r in pipeline.run(spark, sf).collect()}
    assert whole == {(r["doc_id"], r["slot"], r["nth"]) for r in docs.collect()}


def test_stages_take_every_kind_of_row(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    for rows in (helpers.EDGES, []):
        docs = helpers.docs(spark, rows)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= len(rows), name
            if name != "mix_sources":
                assert out.columns == docs.columns


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
