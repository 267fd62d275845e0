from collections import Counter

from palimpsest.llm import tokencounts
from tests.llm import helpers


def test_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encode = tokencounts.encoding(open(tokencounts.RANKS, "rb").read()).encode_ordinary
    n = sorted(len(encode(r["text"])) for r in docs.collect())
    rows = {r["n_tokens"]: r for r in tokencounts.token_counts(docs).collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert r["docs_up_to"] == sum(x <= k for x in n) and r["docs_beyond"] == sum(x > k for x in n)
        assert r["tokens_up_to"] == sum(x for x in n if x <= k)
        assert r["truncated_total"] == sum(min(x, k) for x in n)
        assert abs(r["quantile"] - r["docs_up_to"] / len(n)) < 1e-12
    limits = spark.createDataFrame([(1,), (100,), (512,), (10**7,), (None,), (100,)], "context_limit long")
    got = {r["context_limit"]: (r["truncated_total"], r["docs_cut"]) for r in tokencounts.at_limits(tokencounts.token_counts(docs), limits).collect()}
    assert got == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in (1, 100, 512, 10**7)}


def test_edges(spark):
    rows = {r["n_tokens"]: r["n_docs"] for r in tokencounts.token_counts(helpers.docs(spark)).collect()}
    assert rows[0] == 3 and sum(rows.values()) == len(helpers.EDGES) and max(rows) > 100_000
    assert tokencounts.token_counts(helpers.docs(spark, [])).count() == 0
