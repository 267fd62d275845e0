import json
import subprocess
import urllib.error
import urllib.request
from threading import Thread

import pytest
from pyspark.sql import functions as F

from palimpsest import api
from palimpsest.functions import encoding
from palimpsest.operators import lineage
from palimpsest.sources import gitlog, history
from palimpsest.sources.store import Store
from palimpsest.streaming import reindex
from palimpsest.streaming.debounce import debounced, debounced_stream


class Repo:
    def __init__(self, folder):
        self.folder = folder
        self("init", "-q", "-b", "main")

    def __call__(self, *args):
        env = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "HOME": str(self.folder), "PATH": "/usr/bin:/bin", "GIT_CONFIG_NOSYSTEM": "1"}
        return subprocess.run(["git", "-C", str(self.folder), *args], check=True, capture_output=True, text=True, env=env).stdout

    def commit(self, message, **files):
        for name, content in files.items():
            path = self.folder / name.replace("__", ".")
            if content is None:
                path.unlink()
            else:
                path.write_bytes(content if isinstance(content, bytes) else content.encode())
        self("add", "-A")
        self("commit", "-q", "--allow-empty", "-m", message)


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "repo").mkdir()
    r = Repo(tmp_path / "repo")
    r.commit("first", a__txt="hello foo\n", b__txt="1\n2\n3\n")
    r.commit("second", a__txt="hello foo\nbar\n", c__bin=b"\xff\xfe\x00")
    r("checkout", "-q", "-b", "side")
    r.commit("on the side", a__txt="side\n")
    r.commit("back", a__txt="hello foo\nbar\nbaz\n")
    r("checkout", "-q", "main")
    r.commit("third", b__txt=None)
    r("merge", "-q", "--no-ff", "-m", "merged", "side")
    r.commit("nothing")
    return r


def test_history_of_first_parents(spark, repo):
    gitlog.register(spark)
    for each in (1, 2, 200):
        rows = spark.read.format("git_history").options(path=str(repo.folder), commitsPerPartition=each).load().orderBy("commit_index", "path").collect()
        assert [(r["commit_index"], r["path"], r["change"]) for r in rows] == [(0, "a.txt", "A"), (0, "b.txt", "A"), (1, "a.txt", "M"), (1, "c.bin", "A"), (2, "b.txt", "D"), (3, "a.txt", "M"), (4, None, None)]
        assert rows[0]["content"] == b"hello foo\n" and rows[4]["content"] is None and rows[5]["summary"] == "merged"
    later = spark.read.format("git_history").options(path=str(repo.folder), since=2).load()
    assert sorted(r["commit_index"] for r in later.collect()) == [3, 4]


def test_merges_count_as_one_commit_in_the_replayed_index(spark, tmp_path):
    (tmp_path / "m").mkdir()
    r = Repo(tmp_path / "m")
    r.commit("0", file1="a")
    r("checkout", "-q", "-b", "side")
    r.commit("b", file1="b")
    r.commit("c", file1="c")
    r("checkout", "-q", "main")
    r.commit("1", file2="x")
    r("merge", "-q", "--no-ff", "-m", "2", "side")
    gitlog.register(spark)
    rows = spark.read.format("git_history").option("path", str(r.folder)).load()
    got = {(x["path"], x["token"]): x["commits"] for x in lineage.compat_index(history.versions(history.changes(rows, "path", "commit_index", F.col("content").cast("string")))).collect()}
    assert got == {("file1", "a"): [0], ("file1", "c"): [2], ("file2", "x"): [1, 2]}


def test_texts_and_others(spark):
    rows = [("a.png", b"\x89PNG\r\n\x1a\n\xff\xfe"), ("a.txt", b"\xef\xbb\xbfhi"), ("b.txt", "grüß".encode()), ("c.txt", b"\xff\xff"), ("d.txt", b"x" * 9000 + b"\xff\xfe"), ("e.mp4", b"0000ftyp"), ("noext", b"plain"), ("f.txt", b"\x0f\xef\xf0"), ("g.rtf", b"{\\rtf\xfe\xff"), ("h.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("commit_index", F.lit(0))
    look = {r["path"]: r["x"] for r in df.where("content is not null").select("path", encoding.looks_like_text(F.col("content"), encoding.extension(F.col("path"))).alias("x")).collect()}
    assert look == {"a.png": True, "a.txt": False, "b.txt": True, "c.txt": True, "d.txt": True, "e.mp4": True, "noext": True, "f.txt": True, "g.rtf": True}
    kept, ignored = encoding.split_texts(df)
    assert {r["path"] for r in kept.collect()} == {"b.txt", "e.mp4", "noext", "h.txt"}
    assert {r["path"] for r in ignored.collect()} == {"a.png", "c.txt", "d.txt", "f.txt", "g.rtf"}
    with pytest.raises(Exception):
        encoding.split_texts(df, strict=True)[0].collect()


def test_index_grows_and_answers_stay_exact(spark, repo, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    engine = api.Engine(store)
    assert engine.search("foo", "plain", 0, 10) == {"results": []}
    assert engine.index(str(repo.folder)) == 0 and engine.index(str(repo.folder)) is None
    (hit,) = engine.search("foo bar", "plain", 0, 10)["results"]
    assert hit["file_path"] == "a.txt" and hit["first_match"]["commit_summary"] == "second" and hit["last_match"]["is_head"]
    assert engine.search("zzz", "plain", 0, 10) == {"results": []} and engine.search("foo", "plain", 0, 0) == {"results": []}
    repo.commit("gone", a__txt="nothing\n", d__txt="foo bar\n")
    assert engine.search("foo bar", "plain", 0, 10)["results"] == [hit]
    assert engine.index(str(repo.folder)) == 1
    got = engine.search("foo bar", "plain", 0, 10)["results"]
    assert [(h["file_path"], h["first_match"]["commit_summary"], (h["last_match"] or {}).get("commit_summary")) for h in got] == [("a.txt", "second", "merged"), ("d.txt", "gone", None)]
    assert [h["file_path"] for h in engine.search("fo+ b", "regex", 0, 10)["results"]] == ["d.txt"]
    assert [h["file_path"] for h in engine.search("foo", "plain", 1, 1)["results"]] == ["d.txt"]
    whole = Store(spark, f"file://{tmp_path}/whole")
    reindex.reindex_from(spark, str(repo.folder), whole.folder)
    rows = lambda s, t: sorted(map(str, s.table(t).distinct().collect()))
    assert all(rows(store, t) == rows(whole, t) for t in ("commits", "versions", "postings"))
    text = api.rendered(got[0])
    assert "never" not in text and "\x1b[31mfoo\x1b[0m" in text and text.splitlines()[1].startswith("     1| ")


def test_compaction_changes_no_answer(spark, repo, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    assert store.compact() is None
    for k in range(3):
        reindex.reindex_from(spark, str(repo.folder), store.folder)
        repo.commit("more", **{f"n{k}__txt": f"foo {k}"})
    tables = lambda: {t: sorted(map(str, store.table(t).distinct().collect())) for t in ("commits", "versions", "postings")}
    before = tables()
    assert store.batches() == [0, 1, 2] and store.compact() == 3 and store.batches() == [3]
    assert tables() == before
    assert reindex.reindex_from(spark, str(repo.folder), store.folder) == 4 and store.batches() == [3, 4]


def test_half_written_batches_are_not_seen(spark, repo, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    reindex.reindex_from(spark, str(repo.folder), store.folder)
    before = store.table("versions").count()
    store.table("versions").write.parquet(f"{store.folder}/versions/batch=1")
    assert store.table("versions").count() == before and store.batches() == [0]
    repo.commit("more", e__txt="e")
    assert reindex.reindex_from(spark, str(repo.folder), store.folder) == 1
    assert store.table("versions").count() == before + 1


def test_stream_of_commits(spark, repo, tmp_path):
    gitlog.register(spark)
    read = lambda: spark.readStream.format("git_history").option("path", str(repo.folder)).load()
    said = []
    for _ in range(2):
        q = reindex.reindex(read(), f"file://{tmp_path}/index", f"file://{tmp_path}/check", {"processingTime": "0 seconds"}, lambda s: said.append(s.head()))
        q.processAllAvailable()
        q.stop()
        repo.commit("later", z__txt="later")
    assert said == [4, 5]
    assert Store(spark, f"file://{tmp_path}/index").changes().where("path = 'z.txt'").count() == 1


def test_http(spark, repo, tmp_path):
    engine = api.Engine(Store(spark, f"file://{tmp_path}/index"))
    server = api.serve(engine, api.Config(str(repo.folder), "main", engine.store.folder, "webhook"), "127.0.0.1:0")
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, json.dumps(body).encode() if body is not None else None)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as wrong:
            return wrong.code, json.load(wrong)

    assert ask("/api/health") == (200, {"status": "ok"})
    assert ask("/webhook/reindex", {"commit_id": "x"})[0] == 200
    status, said = ask("/api/search", {"query": " foo ", "page_size": 5})
    assert status == 200 and [h["file_path"] for h in said["results"]] == ["a.txt"]
    assert ask("/api/search", {"query": "  "})[0] == 400 and ask("/api/search", {"query": "(", "mode": "regex"})[0] == 400
    assert {"/api/health", "/api/search", "/docs.json", "/webhook/reindex"} == set(ask("/docs.json")[1]["paths"])
    assert "/webhook/reindex" not in api.openapi()["paths"] and ask("/nowhere")[0] == 404
    server.shutdown()


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"repo_path": "/r", "branch_name": "main", "saved_index_path": "/i", "live_index_config": {"WatchLiveUpdate": {"debounce_milliseconds": 300}}}))
    assert api.Config.read(str(tmp_path / "c.json")) == api.Config("/r", "main", "/i", "watch", 300)


def test_changed_paths(spark):
    rows = [("create", "/HEAD"), ("modify_data", "/refs/heads/main"), ("access", "/HEAD"), ("modify_data", "/index"), ("remove", "/packed-refs"), ("modify_name", "/logs/HEAD"), ("modify_data", "/refs/tags/x")]
    got = reindex.changed_paths(spark.createDataFrame(rows, "kind string, path string")).collect()
    assert [r["path"] for r in got] == ["/HEAD", "/refs/heads/main", "/packed-refs", "/logs/HEAD"]


def brute_signals(rows, wait):
    out = []
    for key in sorted({k for k, _ in rows}):
        armed, dropped = None, 0
        for t in sorted(t for k, t in rows if k == key):
            if armed is not None and t >= armed:
                out.append((key, armed, dropped))
                armed = None
            if armed is None:
                armed, dropped = t + wait, 0
            else:
                dropped += 1
        out.append((key, armed, dropped))
    return sorted(out)


def test_debounced(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("abc"), 1 + rng.randrange(1999)) for _ in range(400)]  # time 0 is late for any watermark
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r["key"], int(r["t"]), r["dropped"]) for r in debounced(df, "k", "ts", 30).select("key", F.unix_seconds("signal_at").alias("t"), "dropped").collect())
    assert got == brute_signals(rows, 30)
    src = f"{tmp_path}/events"
    for lo in range(0, 2000, 500):  # in order of time, so nothing is late
        df.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < lo + 500)).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("end", 10_000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(src)
    out = debounced_stream(spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src), "k", "ts", 30)
    q = out.writeStream.format("memory").queryName("signals").option("checkpointLocation", f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    streamed = sorted((r["key"], r["t"], r["dropped"]) for r in spark.table("signals").select("key", F.unix_seconds("signal_at").alias("t"), "dropped").collect() if r["key"] != "end")
    assert streamed == brute_signals(rows, 30)


def test_a_path_once_ignored_stays_ignored(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    commits = lambda *n: spark.createDataFrame([(k, f"c{k}", None, "s") for k in n], "commit_index long, commit_id string, commit_time timestamp, summary string")
    files = lambda *rows: encoding.split_texts(spark.createDataFrame([(p, k, b) for p, k, b in rows], "path string, commit_index long, content binary"))
    kept, ignored = files(("a", 0, b"fine"), ("b", 0, b"\xff\xfa"))
    store.append(commits(0), kept, ignored)
    kept, ignored = files(("a", 1, b"\xfa"), ("b", 1, b"now it is a text"), ("c", 1, b"new"))
    store.append(commits(1), kept, ignored)
    kept, ignored = files(("a", 2, b"again"), ("c", 2, b"newer"))
    store.append(commits(2), kept, ignored)
    want = [("a", 0), ("c", 1), ("c", 2)]
    assert sorted((r["path"], r["commit_index"]) for r in store.changes().collect()) == want
    store.compact()
    store.append(commits(3), *files(("b", 3, b"text"), ("c", 3, b"newest")))
    assert sorted((r["path"], r["commit_index"]) for r in store.changes().collect()) == [*want, ("c", 3)]


def test_commits_are_numbered_across_ranges(spark):
    rows = [(f"id{k * 7919 % 1000:04}", (k * 31) % 17) for k in range(1000)] * 2
    got = history.numbered_commits(spark.createDataFrame(rows, "commit_id string, at int"), "at").collect()
    want = {c: n for n, (t, c) in enumerate(sorted({(t, c) for c, t in rows}))}
    assert {r["commit_id"]: r["commit_index"] for r in got} == want and len(got) == 1000
