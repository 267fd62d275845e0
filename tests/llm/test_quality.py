import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import quality, sitequality
from tests.llm import helpers

LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy_and_calibration(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["text"], labels[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r["doc_id"] in labels]
    model = quality.train([t for t, _ in rows[::2]], np.array([q for _, q in rows[::2]]))
    p = model.probabilities(pa.array([t for t, _ in rows[1::2]]))
    y = np.array([q for _, q in rows[1::2]])
    assert np.mean((p >= 0.5) == y) > max(0.85, max(y.mean(), 1 - y.mean()) + 0.02)
    assert abs(p.mean() - y.mean()) < 0.12


def test_scores_of_a_batch_are_those_of_single_texts():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=2 << quality.BITS).astype(np.float32), 0.3)
    texts = ["", "a", "ab", "abc d", "Äöü ß word word", "x" * 5000, "one two three " * 400]
    for chunk in (1, 64, 1 << 20):
        old, quality.CHUNK = quality.CHUNK, chunk
        got = model.scores(pa.array(texts))
        quality.CHUNK = old
        for t, z in zip(texts, got):
            s, v = quality.features(np.frombuffer(t.encode(), np.uint8), np.frombuffer(t.lower().encode(), np.uint8))
            assert abs(z - (0.3 + (model.weights[s] * v).sum())) < 1e-3


def test_calibration_recovers_a_curve():
    rng = np.random.default_rng(1)
    z = rng.normal(size=20_000) * 2
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    a, b = quality.calibrate(z, y)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.1


def test_rules_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (7, 1, 0, "x"), (None, 1, 1, None), (2, None, 0, None), (99, 1, 0, None)], LABELS)
    for lab in (labels, labels.limit(0)):
        rows = quality.quality_rules(helpers.docs(spark), lab).collect()
        assert len(rows) == len(helpers.EDGES)
        by = {r["doc_id"]: r for r in rows}
        assert all(by[k]["p_good"] == 0 and by[k]["verdict"] == "drop" and not by[k]["keep"] for k in (3, 4, 5))
        assert all(r["keep"] == (r["p_good"] >= quality.KEEP) for r in rows)
    assert quality.quality_rules(helpers.docs(spark, []), labels).count() == 0


def test_site_posteriors_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = sitequality.site_quality(docs, labels).toPandas().merge(docs.select("doc_id").toPandas(), on="doc_id")
    known = labels.groupBy("doc_id").min("quality").toPandas().set_index("doc_id")["min(quality)"]
    rows["e"] = [float(known[i] > 0) if i in known.index else p for i, p in zip(rows.doc_id, rows.p_text)]

    def strength(g):
        k, n = g["e"].sum(), g["e"].count()
        mu, total = k.sum() / n.sum(), n.sum()
        noise = mu * (1 - mu)
        between = ((n * (k / n - mu) ** 2).sum() - (len(n) - 1) * noise) / (total - (n * n).sum() / total)
        s = round(noise / between - 1, 6) if between > 0 else sitequality.STRONGEST
        return mu, min(max(s, sitequality.WEAKEST), sitequality.STRONGEST)

    hosts, paths = rows.groupby("host"), rows.groupby(["host", "path"])
    mu, s = strength(hosts)
    _, within = strength(paths)
    mean = (hosts["e"].sum() + s * mu) / (hosts["e"].count() + s)
    site = (paths["e"].transform("sum") - rows.e + within * rows.host.map(mean)) / (paths["e"].transform("count") - 1 + within)
    assert np.allclose(rows.p_site, site, atol=2e-5)
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    assert np.allclose(rows.p_good, 1 / (1 + np.exp(-(logit(rows.p_text) + logit(site) - logit(mu)))), atol=1e-3)


def test_rules_as_brute_force(spark, sf):
    """Every row against dictionaries of n-gram shares, built from slices of the text and the hash of each slice alone."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}

    def slot_of(gram):
        v = (int.from_bytes(gram, "little") * 0x9E3779B1) & 0xFFFFFFFF
        v = ((v ^ (v >> 15)) * (0x85EBCA77 + 2 * len(gram))) & 0xFFFFFFFF
        return (v >> (32 - quality.BITS)) + (1 << quality.BITS)

    def finish(x):
        for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> s)) * m) & (2**64 - 1)
        return x ^ (x >> 31)

    def word(w):
        return finish((sum((b + 1) * pow(0x9E3779B97F4A7C15 | 1, k, 1 << 64) for k, b in enumerate(w)) + len(w)) & (2**64 - 1))

    def odds(text):
        raw, low = text.encode(), text.lower().encode()
        words = [word(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+", low)]
        pairs = [finish((a * 0x100000001B3 + b) & (2**64 - 1)) for a, b in zip(words, words[1:])]
        kinds = ([x >> (64 - quality.BITS) for x in words + pairs], [slot_of(raw[i : i + n]) for n in (3, 4) for i in range(len(raw) - n + 1)])
        return model.bias + sum(sum(float(model.weights[s]) for s in k) / len(k) for k in kinds if k)

    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: len(r[1]))[::3]
    for i, text in [r for r in rows if len(r[1]) < 20_000]:
        p = 1 / (1 + math.exp(-(model.slope * odds(text) + model.shift))) if text.strip() else 0.0
        assert abs(got[i]["p_good"] - p) < 1e-4
        assert got[i]["verdict"] == ("drop" if got[i]["p_good"] < 0.5 else "review" if got[i]["p_good"] < 0.8 else "keep")


def test_sample_bound_holds_for_repeated_ids(spark):
    docs = spark.createDataFrame([(k % 2, f"text {k}") for k in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in range(400)], LABELS)
    assert len(quality.labelled_sample(docs, labels, bound=5)) <= 10
    many = spark.createDataFrame([(k, f"text {k}") for k in range(400)], "doc_id long, text string")
    assert 1 <= len(quality.labelled_sample(many, labels, bound=5)) <= 10


def test_no_model_judges_what_it_was_trained_on(spark):
    rows = [(k, f"word{k} only here {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 3 > 0, 0, "x") for k in range(40)], LABELS.replace("quality int", "quality boolean")).withColumn("quality", F.col("quality").cast("int"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("l")})
    sample = quality.labelled_sample(docs, labels)
    models = [quality.fitted([r for r in sample if sitequality.fold_of(r[0]) != k]) for k in (0, 1)]
    got = {r["doc_id"]: r["p_text"] for r in sitequality.site_quality(docs, labels).collect()}
    for i, text in rows:
        assert abs(got[i] - models[sitequality.fold_of(i)].probabilities(pa.array([text]))[0]) < 2e-6


def test_sites_of_urls(spark):
    rows = [(1, "t", "https://A.example/news/x/1.html"), (2, "t", "http://a.example/news/2"), (3, "t", "//a.example/x.html"), (4, "t", None), (5, "t", "nonsense")]
    got = sitequality.site_quality(spark.createDataFrame(rows, "doc_id long, text string, url string"), spark.createDataFrame([], LABELS)).collect()
    assert {r["doc_id"]: (r["host"], r["path"]) for r in got} == {1: ("a.example", "news"), 2: ("a.example", "news"), 3: ("a.example", ""), 4: ("", ""), 5: ("", "")}


def test_site_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (7, 1, 0, "x"), (None, 1, 1, None), (2, None, 0, None)], LABELS)
    rows = sitequality.site_quality(helpers.docs(spark), labels).collect()
    assert len(rows) == len(helpers.EDGES) and all(0 <= r["p_good"] <= 1 for r in rows)
    assert all(not r["keep"] for r in rows if r["doc_id"] in (3, 4, 5))
    assert sitequality.site_quality(helpers.docs(spark, []), labels).count() == 0
    assert sitequality.site_quality(helpers.docs(spark, helpers.EDGES[:1]), labels.limit(0)).count() == 1
