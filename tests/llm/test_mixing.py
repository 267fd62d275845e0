import random
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest

from palimpsest.llm import mixing
from tests.llm import helpers


@pytest.mark.parametrize("seed", range(20))
def test_schedule_is_fair(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 12)
    slots = {f"s{k}": rng.randrange(1, 1 + rng.choice((3, 30, 300))) for k in range(n)}
    period = sum(slots.values())
    order = mixing.schedule(slots, period)
    had = Counter()
    for t, s in enumerate(order, 1):
        had[s] += 1
        assert all(abs(had[x] - slots[x] * t / period) < 1 for x in slots)


def test_every_block_has_one_slot_and_phase_zero_keeps_the_weights():
    blocks = {"a": 700, "b": 90, "c": 11, "d": 1}
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}
    stretches, phases = mixing.plan(blocks, weights)
    slots = {}
    for s, n in blocks.items():
        at, phase = mixing.place(stretches[s], np.arange(n))
        for x, p in zip(at.tolist(), phase.tolist()):
            assert x not in slots and phases[p][0] <= x < phases[p][1]
            slots[x] = s
    assert sorted(slots) == list(range(sum(blocks.values())))
    share = {s: w / 10 for s, w in weights.items()}
    had = Counter()
    for t in range(phases[0][1]):
        had[slots[t]] += 1
        assert all(abs(had[s] - share[s] * (t + 1)) < 1 + 1e-9 for s in blocks)


def test_mixture_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixed(docs, block=4).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    assert len({(r["slot"], r["nth"]) for r in rows}) == len(rows)
    blocks = {(r["source"], r["block_no"]): r["slot"] for r in rows}
    assert sorted(blocks.values()) == list(range(len(blocks)))
    assert all(r["slot"] == blocks[r["source"], r["block_no"]] for r in rows)


def test_edges(spark):
    src = helpers.docs(spark).withColumn("slot", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("old"))
    out = mixing.mixed(src, {"a": 2, "b": 1, None: 1}, block=2)
    assert out.columns == [*helpers.docs(spark).columns, "block_no", "slot", "nth", "phase"]
    rows = out.collect()
    assert len(rows) == len(helpers.EDGES) and len({(r["slot"], r["nth"]) for r in rows}) == len(rows)
    assert mixing.mixed(helpers.docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(src, {"a": 1})


@pytest.mark.parametrize(
    "blocks, weights",
    [
        ({"a": 3000, "b": 5000}, {"a": 1 / 3, "b": 2 / 3}),
        ({"hot": 60000, **{f"s{k}": 1000 for k in range(19)}}, None),
        ({"rare": 3, "b": 30000}, {"rare": 0.00005, "b": 1.0}),
        ({"a": 5, "b": 40, "c": 2000, "d": 1}, {"a": 0.7, "b": 0.1, "c": 3.3, "d": 1e-9}),
    ],
)
def test_phase_zero_keeps_the_exact_weights_within_a_block(blocks, weights):
    weights = weights or {s: n**mixing.TEMPER for s, n in blocks.items()}
    stretches, phases = mixing.plan(blocks, weights)
    slots = {s: mixing.place(stretches[s], np.arange(n))[0] for s, n in blocks.items()}
    assert sorted(x for v in slots.values() for x in v.tolist()) == list(range(sum(blocks.values())))
    end = phases[0][1]
    for s, w in weights.items():
        had = np.cumsum(np.isin(np.arange(end), slots[s]))
        assert np.abs(had - w / sum(weights.values()) * np.arange(1, end + 1)).max() < 1 + 1e-9


def brute(rows, block):
    """The query by its definition: windows of exact fractions, and of the released blocks always the one due first."""
    of = {}
    for i, source in rows:
        of.setdefault(source, []).append(i)
    left = {s: -(-len(v) // block) for s, v in of.items()}
    weights = {s: Fraction(n**mixing.TEMPER) for s, n in left.items()}
    done, out, slot, phase = dict.fromkeys(left, 0), {}, 0, 0
    while left:
        total, began, had = sum(weights[s] for s in left), slot, dict.fromkeys(left, 0)
        while True:
            open_ = [s for s in left if floor(had[s] * total / weights[s]) <= slot - began]
            s = min(open_, key=lambda s: (ceil((had[s] + 1) * total / weights[s]), str(s)))
            out[s, done[s]] = (slot, phase)
            had[s], done[s], left[s], slot = had[s] + 1, done[s] + 1, left[s] - 1, slot + 1
            if not left[s]:
                del left[s]
                break
        phase += 1
    return out


def test_query_as_brute_force(spark, sf):
    rows = [(r["doc_id"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()]
    rows += [(10_000 + k, "hot") for k in range(900)] + [(20_000, "lone")]
    docs = spark.createDataFrame([(i, "t", s) for i, s in rows], "doc_id long, text string, source string")
    got, want = mixing.mixed(docs).collect(), brute(rows, mixing.BLOCK)
    assert {(r["source"], r["block_no"]): (r["slot"], r["phase"]) for r in got} == want
    sizes = Counter((r["source"], r["block_no"]) for r in got)
    last = {s: max(b for x, b in sizes if x == s) for s, _ in sizes}
    assert all(n == mixing.BLOCK or b == last[s] for (s, b), n in sizes.items())
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows) and {(r["slot"], r["nth"]) for r in got} == {(r["slot"], k) for r in got for k in range(sizes[r["source"], r["block_no"]])}


def test_one_hot_source_beside_a_thousand_small_ones():
    blocks = {"hot": 1_000_000, **{f"s{k}": 1 for k in range(1000)}}
    weights = {s: n**mixing.TEMPER for s, n in blocks.items()}
    stretches, phases = mixing.plan(blocks, weights)
    slots = {s: mixing.place(stretches[s], np.arange(n))[0] for s, n in blocks.items()}
    assert sum(len(v) for v in slots.values()) == 1_001_000 == len(set(np.concatenate(list(slots.values())).tolist()))
    had = np.cumsum(np.isin(np.arange(phases[0][1]), slots["hot"]))
    assert np.abs(had - weights["hot"] / sum(weights.values()) * np.arange(1, len(had) + 1)).max() < 1 + 1e-6


def test_blocks_are_doubled_to_keep_the_plan_bounded(spark):
    docs = spark.createDataFrame([(i, "t", "ab"[i % 3 == 0]) for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.mixed(docs, block=2, most=40).collect()
    sizes = Counter((r["source"], r["block_no"]) for r in rows)
    assert len(sizes) <= 40 and max(sizes.values()) == 16 and len(rows) == 500


def test_clashing_names_and_null_ids(spark):
    names = ["Slot", "NTH", "part", "DRAW", "tie", "offset", "n", "at", "source_", "__part", "__row"]
    rows = [(None if k % 2 else 7, f"text {k % 5}", "a", *(f"{k} {x}" for x in names)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{x}` string" for x in names))
    out = mixing.mixed(docs, block=4)
    assert out.columns == ["doc_id", "text", "source", *names[2:], "block_no", "slot", "nth", "phase"]
    got = out.collect()
    assert len({(r["slot"], r["nth"]) for r in got}) == 40
    assert sorted(r["part"] for r in got) == sorted(f"{k} part" for k in range(40))


def test_texts_are_not_shuffled_unless_they_are_wanted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mixed(docs).select("doc_id", "slot")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("Join")[0]
