import random

from palimpsest import queries
from palimpsest.operators import lineage
from palimpsest.operators.lineage import Replay, Token
from palimpsest.sources import history


def versions(spark, rows):
    return history.versions(history.changes(spark.createDataFrame(rows, "path string, commit_index long, content string"), "path", "commit_index", "content"))


def test_runs_are_the_sets():
    rng = random.Random(7)
    for _ in range(300):
        token, commits = Token(), set()
        at = 0
        for _ in range(rng.randrange(1, 12)):
            at = max(0, at + rng.choice([0, 0, 1, 1, 2, 5, -3]))
            if commits and rng.random() < 0.4:
                token.fill(at)
                commits.update(range(max(commits), at))
            else:
                token.add(at)
                commits.add(at)
        assert token.commits == commits
        assert all(a <= b for a, b in token.runs) and all(b + 1 < c for (_, b), (c, _) in zip(token.runs, token.runs[1:]))


def test_a_far_head_costs_nothing():
    """Before, every live token held every commit up to the head."""
    r = Replay()
    r.step(0, "abcd")
    r.step(5, "abce")
    r.finish(10**15)
    assert r.tokens["abc"].runs == [(0, 3), (5, 10**15)] and r.tokens["bcd"].runs == [(0, 3)]


def test_tokens_of_the_same_commits_are_one_row(spark):
    h = versions(spark, [("f", 0, "abcdef"), ("f", 3, None), ("g", 10**12, "xy\nxy")])
    rows = {r["path"]: r for r in lineage.compat_groups(h).collect()}
    assert len(rows) == 2 and sorted(rows["f"]["tokens"]) == ["abc", "bcd", "cde", "def"] and rows["f"]["n_live"] == [0] * 4
    assert (rows["f"]["firsts"], rows["f"]["lasts"], rows["f"]["is_deleted"]) == ([0], [2], True)
    assert (rows["g"]["tokens"], rows["g"]["n_live"], rows["g"]["firsts"], rows["g"]["lasts"]) == (["xy"], [2], [10**12], [10**12])


def test_batches_and_files_meet(spark):
    rows = [(f"f{k % 9}", k, f"abc{k % 4}\nabd" if k % 7 else None) for k in range(80)]
    whole = sorted(map(tuple, lineage.compat_groups(versions(spark, rows)).select("path", "firsts", "lasts", "tokens", "n_live").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, lineage.compat_groups(versions(spark, rows)).select("path", "firsts", "lasts", "tokens", "n_live").collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_query_is_the_index(spark, sf):
    index = lineage.compat_index(history.versions(queries.conversations(spark, sf)))
    want = sorted((r["path"], r["token"], len(r["live"]), ",".join(map(str, r["commits"])), r["is_deleted"]) for r in index.collect())
    got = queries.QUERIES["compat_presence"](spark, sf)
    assert got.columns == ["path", "token", "n_live", "commits", "is_deleted"]
    assert sorted(map(tuple, got.collect())) == want


def test_commits_are_written_before_the_tokens_are_spread(spark, sf):
    plan = queries.QUERIES["compat_presence"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("array_join")
