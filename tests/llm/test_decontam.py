import random
import re

from palimpsest.llm import decontam
from tests.llm import helpers


def norm(t):
    return " " + re.sub(r"[^\w]+|_", " ", t.lower()).strip() + " "


def brute(docs, items):
    out, tests = {}, {}
    for i, b in items:
        words = norm(b).split() if b else []
        tests[i] = {" " + " ".join(words[k : k + decontam.RUN]) + " " for k in range(max(1, len(words) - decontam.RUN + 1))} if words else set()
    for d, t in docs:
        whole = norm(t or "")
        for i, runs in tests.items():
            if n := sum(r in whole for r in runs):
                out[d, i] = n
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, doc_id string")


def test_as_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs += [(9000 + i, f"before {t.upper().replace(' ', ' - ')} after") for i, t in items[:10]]
    items += [(900, "one two"), (901, "x"), (902, "a run of words with exactly eight items"), (903, "…!")]
    docs += [(9100, "one, TWO"), (9101, "xx one twos"), (9102, "x"), (9103, "so: a run of words with exactly eight items.")]
    found = decontam.contaminated(helpers.texts(spark, docs), table(spark, [(i, t, "?") for i, t in items]))
    got = {(r["doc_id"], r["item_id"]): r["runs"] for r in found.collect()}
    assert got == brute(docs, items) and len(got) >= 14


def test_search_finds_what_a_scan_finds():
    rng = random.Random(6)
    for _ in range(200):
        alphabet = b"ab" if rng.random() < 0.5 else b"abcdef "
        make = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
        patterns = list({make(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 20))})
        text = make(rng.randrange(0, 120))
        assert decontam.WuManber(patterns).find(text) == {k for k, p in enumerate(patterns) if p in text}


def test_slices_find_the_same(spark, monkeypatch):
    items = [(k, f"item {k} has its own words number {k} and then some more of them {k}", "") for k in range(30)]
    docs = [(k, f"text {k} item {k} has its own words number {k} and then") for k in range(0, 30, 2)]
    whole = sorted(map(tuple, decontam.contaminated(helpers.texts(spark, docs), table(spark, items)).collect()))
    left = sorted(r["doc_id"] for r in decontam.drop_contaminated(helpers.texts(spark, docs + [(99, "clean")]), table(spark, items)).collect())
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(helpers.texts(spark, docs + [(99, "clean")]), table(spark, items)).collect()) == left == [99]
    assert sorted(map(tuple, decontam.contaminated(helpers.texts(spark, docs), table(spark, items)).collect())) == whole and len(whole) == 15


def test_edges(spark):
    items = [(1, helpers.EDGES[0][1], "a"), (1, helpers.EDGES[0][1], "b"), (2, None, "c"), (None, "wort wort", "d"), (3, "", "e"), (4, "wort " * 20, None), (5, "漢字 😀", "f"), (6, "a text without an id that is as long as others are here", "")]
    src, bench = helpers.docs(spark), table(spark, items)
    got = sorted(((r["doc_id"], r["item_id"], r["runs"]) for r in decontam.contaminated(src, bench).collect()), key=str)
    assert got == sorted([(1, 1, 5), (1, 1, 5), (2, 1, 5), (6, 4, 1), (6, None, 1), (7, 5, 1), (None, 6, 6)], key=str)
    kept = decontam.drop_contaminated(src, bench)
    assert kept.columns == src.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 4, 5, None]
    assert decontam.contaminated(helpers.docs(spark, []), bench).count() == 0
    assert decontam.contaminated(src, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(src, bench.limit(0)).count() == len(helpers.EDGES)


def test_items_without_an_id_count(spark):
    items = [(None, "these are eight words that no one may train on", ""), (None, "and this is another one of that kind here", "")]
    docs = helpers.texts(spark, [(1, "so these are eight words that no one may train on it"), (2, "clean"), (None, "and this is another one of that kind here")])
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, table(spark, items)).collect()] == [2]
    assert sorted(map(tuple, decontam.contaminated(docs, table(spark, items)).collect()), key=str) == [(1, None, 3), (None, None, 2)]
