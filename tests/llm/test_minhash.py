import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import minhash
from palimpsest.llm.common import buffers, word_hashes
from palimpsest.llm.components import components
from tests.llm import helpers


class Sets(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def brute(rows, least):
    """Groups by exact Jaccard similarity of word triples over all pairs."""
    sets = {}
    for i, t in rows:
        words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
        if words:
            k = min(3, len(words))
            sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_pairs_are_those_of_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(1)
    for i, (_, t) in enumerate(rows[:60]):
        words = t.split()
        for _ in range(max(1, len(words) // 40)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((10_000 + i, " ".join(words)))
    found = {r["doc_id"]: r["rep_doc_id"] for r in minhash.near_duplicates(helpers.texts(spark, rows)).collect()}
    same = lambda a, b: found.get(a, a) == found.get(b, b)
    sure = brute(rows, 0.65)
    assert len(sure) > 60
    assert sum(same(a, b) for a, b in sure) >= 0.98 * len(sure)
    likely = brute(rows, 0.5)
    assert sum(same(a, b) for a, b in likely) >= 0.9 * len(likely)
    sets = Sets()
    for a, b in brute(rows, 0.35):
        sets.join(a, b)
    assert all(sets.root(i) == sets.root(r) for i, r in found.items())


def exhaustive(rows):
    """Groups by comparing all signatures that share a band, pair by pair; the signatures in whole numbers from the definition."""
    ids, sigs = [], []
    for i, t in rows:
        data, at = buffers(pa.array([t.lower()]))
        words, _ = word_hashes(data, at)
        if len(words):
            sh = [int(x) for x in minhash.shingles(words)]
            sigs.append([min((int(a) * x + int(b)) % 2**64 >> 32 for x in sh) & 0xFFFF for a, b in zip(minhash._A[:, 0], minhash._B[:, 0])])
            ids.append(i)
    sigs, sets, k = np.array(sigs), Sets(), minhash.ROWS
    for n in range(len(ids)):
        same = sigs[n + 1 :] == sigs[n]
        band = same.reshape(len(same), minhash.BANDS, k).all(axis=2).any(axis=1)
        for m in np.flatnonzero(band & (same.sum(axis=1) >= minhash.ALIKE * minhash.MINIMA)):
            sets.join(ids[n], ids[n + 1 + m])
    return {i: sets.root(i) for i in list(sets) if sets.root(i) != i}


@pytest.mark.parametrize("split", (minhash.SPLIT, 12))
def test_large_buckets_lose_no_link(spark, split):
    """With pieces of twelve nodes the buckets of boilerplate and of groups are large; the groups are still those of all pairs."""
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(30)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(30)] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(words)))
    shared = " ".join(f"boiler{k}" for k in range(12))
    rows += [(len(rows) + k, f"{shared} " + " ".join(f"y{rng.randrange(10_000)}" for _ in range(12))) for k in range(40)]
    rng.shuffle(rows)
    want = exhaustive(rows)
    found = {r["doc_id"]: r["rep_doc_id"] for r in minhash.near_duplicates(helpers.texts(spark, rows), split).collect()}
    assert found == want and len(found) > 50


def test_rows_are_dropped_by_their_own_texts(spark):
    a, b = "the first text of some length that has a copy in this table", "quite another text which nobody has copied anywhere at all"
    rows = [(1, a), (2, a), (2, b), (None, a), (None, a.upper()), (None, "a third text of its own without an id and a copy"), (3, b + " ha"), (4, None), (4, None), (5, "...")]
    kept = minhash.drop_near_duplicates(helpers.texts(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (2, b), (None, rows[5][1]), (4, None), (5, "...")], key=str)


def test_clashing_names(spark):
    names = ["row_key", "COPIES", "copy_id", "copy_key", "node", "key", "rep", "__row", "__key"]
    docs = spark.createDataFrame([(k // 2, "the same words in all of these rows here", *names) for k in range(6)], "doc_id long, text string, " + ", ".join(f"`{x}` string" for x in names))
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(0, "the same words in all of these rows here", *names)]


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    rng.shuffle(edges)
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    table = spark.createDataFrame([*edges, (None, 5), (7, 7), edges[0]], "x long, y long")
    found = {r["node"]: r["root"] for r in components(table, "x", "y").collect()}
    assert found == {n: sets.root(n) for n in list(sets) if sets.root(n) != n}
    assert components(table.limit(0), "x", "y").count() == 0


def test_signatures_estimate_similarity():
    data, at = buffers(__import__("pyarrow").array(["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q"]))
    words, starts = word_hashes(data, at)
    a, b = (minhash.signature(minhash.shingles(words[s:e])) for s, e in zip(starts[:-1], starts[1:]))
    assert abs(np.mean(a == b) - 13 / 15) < 0.12


def test_edges(spark):
    found = sorted(map(tuple, minhash.near_duplicates(helpers.docs(spark)).collect()))
    assert found == [(2, 1, 2)]
    kept = minhash.drop_near_duplicates(helpers.docs(spark))
    assert kept.columns == helpers.docs(spark).columns
    ids = defaultdict(int)
    for r in kept.collect():
        ids[r["doc_id"]] += 1
    assert ids == {1: 1, 3: 1, 4: 1, 5: 1, None: 2, 6: 1, 7: 1}
    assert {r["doc_id"] for r in kept.where("text like '%brown fox%'").collect()} == {1}
    assert minhash.near_duplicates(helpers.docs(spark, [])).count() == 0
    assert minhash.drop_near_duplicates(helpers.docs(spark, [])).count() == 0


def test_many_copies_and_chains(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen".split()
    rows = [(i, " ".join(base)) for i in range(300)] + [(1000 + k, " ".join([*base[k:], *(f"new{j}" for j in range(k))])) for k in range(1, 4)]
    found = list(minhash.near_duplicates(helpers.texts(spark, rows)).collect())
    assert {r["doc_id"] for r in found} >= set(range(1, 300)) | {1001}
    assert {r["rep_doc_id"] for r in found} == {0}
