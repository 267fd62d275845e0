"""Mixing sources to target weights by Pfair scheduling of blocks, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import free_names

#: Documents of a block; the power of the block counts to which default weights are proportional.
BLOCK, TEMPER = 16, 0.7
#: Documents of a part of a source, about; parts are numbered apart, so that no task orders a whole source.
PART_DOCS = 512
#: The bound on the blocks of a plan, and so on what is broadcast (4 bytes a block): blocks are doubled until there are no more.
MOST_BLOCKS = 1 << 22


def exact(weights: dict) -> tuple[dict, int]:
    """Whole numbers in exactly the proportion of the weights, and their sum."""
    shares = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in shares.values()))
    whole = {s: int(x * scale) for s, x in shares.items()}
    by = gcd(*whole.values())
    return {s: w // by for s, w in whole.items()}, sum(whole.values()) // by


def _order(slots: list[int], period: int, left: list[int] | None = None) -> Iterator[int]:
    """Numbers of the sources of the slots of schedule(), for a period, or until a source has none of its left blocks."""
    releases = [(0, i, 0) for i in range(len(slots))]
    due: list[tuple[int, int, int]] = []
    t = 0
    while left is not None or t < period:
        while releases and releases[0][0] <= t:
            _, i, j = heapq.heappop(releases)
            heapq.heappush(due, (-(-(j + 1) * period // slots[i]), i, j))
        _, i, j = heapq.heappop(due)
        yield i
        if left is not None and j + 1 == left[i]:
            return
        if left is not None or j + 1 < slots[i]:
            heapq.heappush(releases, ((j + 1) * period // slots[i], i, j + 1))
        t += 1


def schedule(slots: dict, period: int) -> list:
    """The source of every slot of a period: block j of a source with q slots is released at floor(j*period/q),
    is due at ceil((j+1)*period/q), and of the released blocks the one due first is next (ties by name)."""
    order = sorted(slots, key=str)
    return [order[i] for i in _order([slots[s] for s in order], period)]


@dataclass
class Stretch:
    """A stretch of the mixture of one source: its first block, first slot, and slots within a period."""

    first: int
    start: int
    phase: int
    places: np.ndarray
    period: int


def plan(blocks: dict, weights: dict) -> tuple[dict[object, list[Stretch]], list[tuple[int, int]]]:
    """For each source its stretches, and (start, end) of each phase.

    Phase 0 has the target weights, taken as exact fractions, and lasts until a source has no block
    left. Then its weight is shared among the others in proportion, and so on; every block gets
    exactly one slot. A phase is scheduled as a whole.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = {s: 0 for s in left}
    out: dict[object, list[Stretch]] = {s: [] for s in left}
    phases = []
    start = 0
    slots, period = exact({s: weights[s] for s in left}) if left else ({}, 0)
    while left:
        names = sorted(left, key=str)
        seq = np.fromiter(_order([slots[s] for s in names], period, [left[s] for s in names]), np.int32)
        end = len(seq)
        used = np.bincount(seq, minlength=len(names))
        places = np.argsort(seq, kind="stable").astype(np.int32 if end < 1 << 31 else np.int64)
        for s, mine in zip(names, np.split(places, np.cumsum(used)[:-1])):
            out[s].append(Stretch(done[s], start, len(phases), mine, end))
            done[s] += len(mine)
            left[s] -= len(mine)
            if not left[s]:
                del left[s]
                period -= slots[s]
        phases.append((start, start + end))
        start += end
    return out, phases


def place(stretches: list[Stretch], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and phase of blocks of a source."""
    k = np.searchsorted([s.first for s in stretches], block, side="right") - 1
    slot = np.zeros(len(block), np.int64)
    phase = np.zeros(len(block), np.int32)
    for i in np.unique(k):
        at, s = k == i, stretches[i]
        j = block[at] - s.first
        q = len(s.places)
        slot[at] = s.start + j // q * s.period + s.places[j % q]
        phase[at] = s.phase
    return slot, phase


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, most: int = MOST_BLOCKS) -> DataFrame:
    """docs with block_no, slot, nth and phase: where the mixture has each document.

    The documents of a source, in an order drawn by a hash of doc_id, are cut into blocks of
    ``block`` documents (the last may hold fewer). A slot takes one block. Sorted by slot, and by
    nth within the block, the rows are the mixture: in phase 0, after any number t of slots, a
    source of weight w has had w*t blocks within less than one. When a source has none left, the
    phase ends, and the others go on with weights in the same proportion; so every document comes
    exactly once, and what is beyond the target mixture has phase > 0. ``weights`` maps sources
    (null as None) to weights above 0, which are taken exactly; by default they are proportional to
    the number of blocks to the power TEMPER. If that makes more than ``most`` blocks, block is
    doubled until it doesn't, which bounds the plan whatever the corpus.

    A null source is a source of its own. Rows with a null doc_id come in the order of a hash of
    the text; repeated rows each have a place, ties go by that hash. Null or empty texts are
    documents like others. An empty table gives no rows. A source without a weight is an error.
    Columns of docs that are named as the four new ones, in any case, are replaced; all others may
    have any name.

    The driver gets one row per source, and plans and broadcasts 4 bytes a block. No task numbers a
    whole source: each is cut by the hash into parts of about PART_DOCS documents, whose counts give
    the offsets. Columns that the caller doesn't take are not shuffled; the text itself orders
    nothing, its hash is made where it is read.
    """
    spark = docs.sparkSession
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("block_no", "slot", "nth", "phase")])
    src, draw, part, tie, offset, n, at = free_names(plain, "source_", "draw", "part", "tie", "offset", "n", "at")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    found = plain.select(source.alias("s"), F.col("doc_id").isNull().alias("bare")).groupBy("s").agg(F.count("*"), F.max("bare")).collect()
    docs_of = {r[0]: r[1] for r in found}
    blocks = lambda: {s: -(-m // block) for s, m in docs_of.items()}
    while sum(blocks().values()) > max(most, len(docs_of)):
        block *= 2
    sizes = blocks()
    if weights is None:
        target = {s: m**TEMPER for s, m in sizes.items()}
    else:
        named = {"null" if s is None else f"={s}": float(w) for s, w in weights.items()}
        if missing := [s for s in sizes if named.get(s, 0) <= 0]:
            raise ValueError(f"sources without a weight: {sorted(missing)}")
        target = {s: named[s] for s in sizes}
    shared = spark.sparkContext.broadcast(plan(sizes, target)[0])

    @F.arrow_udf("slot long, phase int")
    def where(source: pa.Array, number: pa.Array) -> pa.Array:
        names, codes = source.dictionary_encode().dictionary.to_pylist(), source.dictionary_encode().indices.to_numpy()
        numbers = number.to_numpy()
        slot, phase = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int32)
        for i, name in enumerate(names):
            mine = codes == i
            slot[mine], phase[mine] = place(shared.value[name], numbers[mine])
        return pa.StructArray.from_arrays([pa.array(slot), pa.array(phase)], names=["slot", "phase"])

    parts = -(-max(docs_of.values(), default=1) // PART_DOCS)
    drawn = F.xxhash64(F.col("doc_id").cast("long"), F.lit(20240607))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(drawn) if any(r[2] for r in found) else drawn  # texts are read for this only if ids are missing
    keyed = plain.withColumns({src: source, draw: drawn, tie: F.xxhash64("text"), part: F.pmod(spread, F.lit(parts))})
    counts = keyed.groupBy(src, part).agg(F.count("*").alias(n))
    before = Window.partitionBy(src).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(offset, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    within = Window.partitionBy(src, part).orderBy(draw, tie)
    return (
        keyed.join(offsets, [src, part])
        .withColumn(n, F.col(offset) + F.row_number().over(within) - 1)
        .withColumns({"block_no": F.floor(F.col(n) / block).cast("long"), "nth": (F.col(n) % block).cast("int")})
        .withColumn(at, where(src, "block_no"))
        .select(*[F.col(f"`{c}`") for c in plain.columns], "block_no", F.col(at)["slot"].alias("slot"), "nth", F.col(at)["phase"].alias("phase"))
    )
