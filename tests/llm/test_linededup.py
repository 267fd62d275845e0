import random
from collections import Counter
from itertools import combinations

import pytest

from palimpsest.llm import linededup
from tests.llm import helpers


def run(spark, rows):
    out = linededup.dedup_lines(helpers.texts(spark, rows))
    return {r["doc_id"]: (r["text"], r["__lines_gone"]) for r in out.collect()}


def size(line):
    return len("".join(line.split()))


def diff(a, b):
    """Patience diff by its definition: pairs of places of two lists of lines."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in diff(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*diff(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not anchors:
        return []
    best = [(0, [])]  # the heaviest chain that ends at each anchor, over all earlier chains
    for i, j in anchors:
        w, chain = max(((w, c) for w, c in best if not c or c[-1][1] < j), key=lambda x: x[0])
        best.append((w + size(a[i]), [*chain, (i, j)]))
    chain = max(best, key=lambda x: x[0])[1]
    out, p, q = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += [(p + x, q + y) for x, y in diff(a[p:i], b[q:j])]
        if i < len(a):
            out.append((i, j))
        p, q = i + 1, j + 1
    return out


def runs(places):
    out = []
    for k in sorted(places):
        if out and out[-1][-1] == k - 1:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def brute(rows):
    """The definition over all pairs of documents, without anything of the module."""
    docs = {i: [x.strip() for x in t.split("\n")] for i, t in rows if i is not None and t}
    holders = Counter(x for t in docs.values() for x in set(t) if x)
    held = {x for x, n in holders.items() if n > 1}
    hot = {x for x, n in holders.items() if n > linededup.RARE}
    out = {}
    for i, mine in docs.items():
        gone = set()
        for j, other in docs.items():
            common = set(mine) & set(other) & held
            if j >= i or not common - hot:
                continue
            p, q = ([k for k, x in enumerate(t) if x in common] for t in (mine, other))
            pairs = [(p[x], q[y]) for x, y in diff([mine[k] for k in p], [other[k] for k in q])]
            gone |= {x for x, _ in pairs}
            taken = {y for _, y in pairs}
            moved = {(k, other.index(x)) for k, x in enumerate(mine) if x in common and mine.count(x) == 1 == other.count(x) and k not in gone_by(pairs) and other.index(x) not in taken}
            for k, y in sorted(moved):
                if (k - 1, y - 1) not in moved:
                    n = 1
                    while (k + n, y + n) in moved:
                        n += 1
                    if sum(size(mine[k + x]) for x in range(n)) >= linededup.BLOCK_CHARS:
                        gone |= set(range(k, k + n))
        earlier = [t for j, t in docs.items() if j < i]
        for a in range(len(mine)):
            for e in range(a + 1, len(mine) + 1):
                block = mine[a:e]
                if any(x not in hot for x in block):
                    break
                if sum(map(size, block)) >= linededup.BLOCK_CHARS and any(t[k : k + len(block)] == block for t in earlier for k in range(len(t))):
                    gone |= set(range(a, e))
        for r in runs(gone):
            if sum(size(mine[k]) for k in r) < linededup.BLOCK_CHARS:
                gone -= set(r)
        out[i] = gone
    return out


def gone_by(pairs):
    return {x for x, _ in pairs}


def agree(spark, rows):
    got, want = run(spark, rows), brute(rows)
    for i, t in rows:
        gone = want.get(i, set())
        assert got[i] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)), i
    return sum(n for _, n in got.values())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_as_brute_force_over_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    pool = [f"a shared line of the pool, {'x' * k}" for k in range(12)] + ["short", "tiny", "}"]
    for i in range(80):
        rows.append((5000 + i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {k} {rng.random()}" for k in range(rng.randrange(1, 15)))))
    assert agree(spark, rows) > 100


@pytest.mark.parametrize("rare", (1, 3, 16, 1000))
def test_as_brute_force_on_short_repeated_and_hot_lines(spark, monkeypatch, rare):
    """Characters of the lines are powers of two, so that no two alignments weigh the same."""
    monkeypatch.setattr(linededup, "RARE", rare)
    rng = random.Random(6)
    pool = [chr(97 + k) * 2**k for k in range(7)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.85 else rng.choice(["", f"own line {i} {rng.random()}"]) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    rows += [(100 + i, "\n".join(rng.sample([f"rare {k} " + "y" * 2**k for k in range(6)] + pool[:4], rng.randrange(2, 8)))) for i in range(30)]
    assert agree(spark, rows) > 50


def test_patience_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = linededup.patience(a, b, {})
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8], {}) == [(1, 1), (2, 2)]


def test_heaviest_increasing_is_best():
    rng = random.Random(5)
    for _ in range(100):
        v = [rng.randrange(6) for _ in range(7)]
        w = [rng.randrange(1, 9) for _ in v]
        got = linededup.heaviest_increasing(v, w)
        assert all(v[x] < v[y] for x, y in zip(got, got[1:]))
        best = max((sum(w[i] for i in c) for n in range(1, 8) for c in combinations(range(7), n) if all(v[x] < v[y] for x, y in zip(c, c[1:]))), default=0)
        assert sum(w[i] for i in got) == best


def test_block_goes_from_the_later_document_only(spark):
    block = "this passage is found in both of the documents\nand it goes on for a second line of words"
    got = run(spark, [(1, f"first\n{block}\nend one"), (2, f"second\n{block}\nend two"), (3, "}\n}\nend three")])
    assert got[1] == (f"first\n{block}\nend one", 0)
    assert got[2] == ("second\nend two", 2)
    assert got[3] == ("}\n}\nend three", 0)


def test_edges(spark):
    src = helpers.docs(spark)
    out = linededup.dedup_lines(src)
    assert out.columns == [*src.columns, "__lines_gone"]
    rows = sorted(((r["doc_id"], r["text"], r["__lines_gone"]) for r in out.collect()), key=str)
    assert len(rows) == len(helpers.EDGES)
    by = dict((i, (t, n)) for i, t, n in rows if i is not None)
    assert by[2] == ("", 1) and by[1][1] == 0 and by[3] == (None, 0) and by[4] == ("", 0) and by[5] == (" \n\t\n", 0)
    assert by[6] == (helpers.LONG, 0)
    assert linededup.dedup_lines(helpers.docs(spark, [])).count() == 0


def test_any_earlier_document_is_a_partner(spark):
    x = "this line is held by the first document only once"
    block = "one two\nthree four\nfive six\nseven eight"
    rows = [(1, x), (2, f"{x}\nown\n{x}"), (3, f"{x}\nother\n{x}"), (4, "seven eight\nfive six\nthree four\none two"), (5, f"five\n{block}"), (6, f"six\n{block}")]
    got = run(spark, rows)
    assert got[3] == ("other", 2)
    assert got[6] == ("six", 4)


def test_a_hot_line_makes_no_pairs(spark):
    """Ten thousand documents share short lines in blocks and apart; pairs would be 50 million."""
    rows = [(i, f"own line of number {i}\nHome\nAbout us\nContact page\nown end {i}\nHome") for i in range(10_000)]
    got = run(spark, rows)
    assert got[0] == (rows[0][1], 0)
    assert all(got[i] == (f"own line of number {i}\nown end {i}\nHome", 3) for i in range(1, 10_000))


def test_clashing_names(spark):
    names = ["row", "ID", "key", "gone", "__row", "__gone", "__LINES_GONE"]
    docs = spark.createDataFrame([(k, "the same long line in all of these rows", *names) for k in range(3)], "doc_id long, text string, " + ", ".join(f"`{x}` string" for x in names))
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", *names[:-1], "__lines_gone"]
    assert {tuple(r)[2:8] for r in out.collect()} == {tuple(names[:-1])} and sorted(r["__lines_gone"] for r in out.collect()) == [0, 1, 1]
