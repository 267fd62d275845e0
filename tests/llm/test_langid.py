import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import langid
from tests.llm import helpers


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    net = langid.fresh(["a", "b", "c"], hidden=3, seed=1)
    for p in net.params():
        p += rng.normal(size=p.shape).astype(np.float32) * 0.1
    x, y, mask = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1]), np.ones((6, 4), np.float32)
    mask[4:, 1] = 0
    grads, _ = net.gradients(x, y, mask)
    for g, p in zip(grads, net.params()):
        places = [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g).ravel())[:4]]
        for at in places:
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = net.gradients(x, y, mask)[1]
            p[at] = old - eps
            down = net.gradients(x, y, mask)[1]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-3 + 0.03 * abs(g[at])


def labelled(net, text):
    """(class probabilities at every byte): byte by byte from the definition, each window read from MARGIN bytes before to MARGIN after it."""
    m, w, hid = langid.MARGIN, langid.WINDOW, net.u[0].shape[0]
    soft = lambda x: x / (1 + np.abs(x))
    out = []
    for lo in range(0, len(text), w):
        span = [text[i] if 0 <= i < len(text) else 0 for i in range(lo - m, lo + w + m)]
        sides = []
        for side, order in ((0, range(len(span))), (1, range(len(span) - 1, -1, -1))):
            h, at = np.zeros(hid), {}
            for t in order:
                g = net.w[side][span[t]].astype(float)
                hu = h @ net.u[side]
                z, r = ((1 + soft(g[i * hid : (i + 1) * hid] + hu[i * hid : (i + 1) * hid])) / 2 for i in (0, 1))
                n = soft(g[2 * hid :] + r * hu[2 * hid :])
                h = at[t] = (1 - z) * n + z * h
            sides.append(at)
        for t in range(m, m + min(w, len(text) - lo)):
            s = np.concatenate([sides[0][t], sides[1][t]]) @ net.v + net.c
            e = np.exp(s - s.max())
            out.append(e / e.sum())
    return np.array(out).reshape(len(text), len(net.classes))


def test_pooling_is_the_sum_over_all_positions():
    rng = np.random.default_rng(1)
    net = langid.fresh(["a", "b", "c"], seed=2)
    rows = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 15, 127, 128, 129, 144, 1000)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    p, wins = langid.pooled(net, np.frombuffer(b"".join(rows), np.uint8), offsets)
    for k, r in enumerate(rows):
        each = labelled(net, r)
        assert np.allclose(p[k], each.sum(axis=0) / max(1, len(r)), atol=1e-4)
        assert abs(wins[k] - np.bincount(each.argmax(axis=1), minlength=3)).sum() <= 2 if r else not wins[k].any()


def test_query_as_brute_force(spark, sf):
    """Every row of the query against the network run byte by byte in doubles."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    net = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: len(x[1]))
    for i, text in rows[::20]:
        each = labelled(net, text.encode())
        mean = each.mean(axis=0)
        assert abs(got[i]["p"] - mean.max()) < 1e-3 and got[i]["positions"] == len(text.encode()) and got[i]["keep"] == (mean.max() >= langid.CONFIDENT)
        assert got[i]["lang"] == net.classes[mean.argmax()] and abs(got[i]["agree"] - (each.argmax(axis=1) == mean.argmax()).sum()) <= 1 + len(each) // 500


def test_sample_bounds_hold_and_every_label_is_a_class(spark):
    rows = [(None, f"text number {k} of this kind " * 9, "en") for k in range(400)] + [(1, "the same row each time", "de")] * 300 + [(5, "só um", "pt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, per_class=20, windows=50)
    by = {x: [s for s in sample if s[0] == x] for x in {s[0] for s in sample}}
    assert set(by) == {"en", "de", "pt"} and all(len(v) <= 50 for v in by.values()) and len(by["de"]) == 1 and len(by["pt"]) == 1
    assert len(by["en"]) == 50
    text = "".join(chr(97 + k % 26) for k in range(1000))
    whole = langid.training_sample(spark.createDataFrame([(1, text, "x")], docs.schema))
    m = langid.MARGIN
    assert sorted(raw[m : m + n].decode() for _, raw, n in whole) == sorted(text[i : i + langid.WINDOW] for i in range(0, 1000, langid.WINDOW))


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    net = langid.fit(train)
    rows = [(r["lang"], r["text"].encode()) for r in rest.where("text <> ''").collect()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    p, _ = langid.pooled(net, np.frombuffer(b"".join(t for _, t in rows), np.uint8), offsets)
    right = [net.classes[k] == lang for k, (lang, _) in zip(p.argmax(axis=1), rows)]
    assert np.mean(right) > 0.95


def test_edges(spark):
    few = [(100 + i, t, lang, "a", None, None, None, None) for i in range(12) for lang, t in (("en", "the cat and the dog ran with that other one"), ("de", "der hund und die katze liefen mit dem anderen"))]
    src = helpers.docs(spark, [*helpers.EDGES, *few])
    rows = langid.identify(src).collect()
    assert len(rows) == len(helpers.EDGES) + len(few)
    by = {r["doc_id"]: r for r in rows}
    for k in (3, 4):
        assert (by[k]["lang"], by[k]["p"], by[k]["positions"], by[k]["keep"]) == ("und", 0.0, 0, False)
    assert by[6]["positions"] == len(helpers.LONG) and by[1]["lang"] == "en" and by[111]["keep"]
    kept = langid.drop_unidentified(src)
    assert kept.columns == src.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["keep"]}
    assert langid.identify(helpers.docs(spark, [])).count() == 0
    assert {r["lang"] for r in langid.identify(helpers.docs(spark, helpers.EDGES[3:4])).collect()} == {"und"}
    bare = src.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang"], r["keep"]) for r in langid.identify(bare).where("text <> ''").collect()} == {("und", True)}
    assert langid.drop_unidentified(bare).count() == src.where("text <> ''").count()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog", "en", "mine", "mine") for k in range(8)], "doc_id long, text string, lang string, said string, `__said` string")
    out = langid.drop_unidentified(docs)
    assert out.columns == docs.columns and {r["said"] for r in out.collect()} == {"mine"}
