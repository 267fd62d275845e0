"""Line dedup: patience alignment of documents that share rare lines; common blocks go from the later document."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_names, written

#: A common block goes if its lines hold this many characters other than white space; a line in more documents than RARE is hot, and finds no partners.
BLOCK_CHARS, RARE = 20, 16

_LINE_SCHEMA = "h long, doc_id long, rk long, at array<int>, chars int"


def _lines(batches):
    for batch in batches:
        h, ids, rks, at, chars = [], [], [], [], []
        for doc_id, rk, text in zip(batch.column("doc_id").to_pylist(), batch.column("rk").to_pylist(), batch.column("text").to_pylist()):
            seen: dict[str, list[int]] = {}
            for i, line in enumerate(text.split("\n")):
                if line := line.strip():
                    seen.setdefault(line, []).append(i)
            for line, places in seen.items():
                h.append(xxhash.xxh3_64_intdigest(line) - (1 << 63))
                chars.append(len("".join(line.split())))
            at += seen.values()
            ids += [doc_id] * len(seen)
            rks += [rk] * len(seen)
            if len(h) > 50_000:
                yield pa.record_batch([pa.array(h, pa.int64()), pa.array(ids, pa.int64()), pa.array(rks, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(chars, pa.int32())], names=["h", "doc_id", "rk", "at", "chars"])
                h, ids, rks, at, chars = [], [], [], [], []
        if h:
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(ids, pa.int64()), pa.array(rks, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(chars, pa.int32())], names=["h", "doc_id", "rk", "at", "chars"])


def heaviest_increasing(values: list[int], weights: list[int]) -> list[int]:
    """Indexes of the increasing subsequence of greatest weight (the earliest such by index)."""
    order = sorted(set(values))
    best: list[tuple[int, int]] = [(0, -1)] * (len(order) + 1)  # Fenwick tree of (weight, -index)
    back = [-1] * len(values)
    top = (0, -1)
    for i, v in enumerate(values):
        k = bisect_left(order, v)
        got, j = (0, -1), k
        while j > 0:
            if best[j][0] > got[0]:
                got = best[j]
            j -= j & -j
        back[i] = got[1]
        mine = (got[0] + weights[i], i)
        j = k + 1
        while j <= len(order):
            if best[j][0] < mine[0]:
                best[j] = mine
            j += j & -j
        if mine[0] > top[0]:
            top = mine
    out, i = [], top[1]
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int], weight: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two lists of line hashes.

    In a range: equal ends are taken, then lines that are unique on both sides anchor it along
    their heaviest increasing subsequence, and the ranges between anchors are aligned likewise.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, list[int]] = {}
        for side, lo, hi, seq in ((0, a0, a1, a), (1, b0, b1, b)):
            for i in range(lo, hi):
                e = once.setdefault(seq[i], [0, 0, -1, -1])
                e[side] += 1
                e[2 + side] = i
        anchors = sorted((e[2], e[3], weight.get(h, 1)) for h, e in once.items() if e[0] == 1 and e[1] == 1)
        if not anchors:
            continue
        kept = [anchors[i] for i in heaviest_increasing([x[1] for x in anchors], [x[2] for x in anchors])]
        pa_, pb_ = a0, b0
        for i, j, _ in kept:
            todo.append((pa_, i, pb_, j))
            out.append((i, j))
            pa_, pb_ = i + 1, j + 1
        todo.append((pa_, a1, pb_, b1))
    return sorted(out)


def _aligned(lines: list[tuple[list[int], list[int], int]]) -> set[int]:
    """Lines of the later document that go with lines of one earlier document.

    lines: for each common line its places in the later document, in the earlier, its characters.
    Beyond the alignment, blocks that moved (runs contiguous in both) count if long enough.
    """
    mine = sorted((i, k) for k, (x, _, _) in enumerate(lines) for i in x)
    other = sorted((j, k) for k, (_, y, _) in enumerate(lines) for j in y)
    if len(mine) == len(other) and [k for _, k in mine] == [k for _, k in other]:
        return {i for i, _ in mine}
    pairs = patience([k for _, k in mine], [k for _, k in other], {k: x[2] for k, x in enumerate(lines)})
    out = {mine[i][0] for i, _ in pairs}
    taken = {other[j][0] for _, j in pairs}
    moved = sorted((x[0], y[0], c) for x, y, c in lines if len(x) == 1 and len(y) == 1 and x[0] not in out and y[0] not in taken)
    run: list[tuple[int, int, int]] = []
    for step in [*moved, None]:
        if run and (step is None or step[0] != run[-1][0] + 1 or step[1] != run[-1][1] + 1):
            if sum(c for _, _, c in run) >= BLOCK_CHARS:
                out |= {i for i, _, _ in run}
            run = []
        if step:
            run.append(step)
    return out


def _filtered(lines: set[int], chars: dict[int, int]) -> list[int]:
    """Those of the lines that lie in runs of consecutive ones with at least BLOCK_CHARS characters."""
    out: list[int] = []
    run: list[int] = []
    for i in [*sorted(lines), -1]:
        if run and i != run[-1] + 1:
            if sum(chars[j] for j in run) >= BLOCK_CHARS:
                out += run
            run = []
        run.append(i)
    return out


_ROW_SCHEMA = "doc_id long, rk long, sig binary, h array<long>, at array<array<int>>, chars array<int>, hot array<boolean>, held array<boolean>, sure array<boolean>, seeks array<boolean>"


def _rows(batches):
    """Of each row its shared lines: sig stands for their sequence; held lines stand in an earlier document; sure ones go
    in any case; seeks marks those of which only alignments or hot blocks tell."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("sig", "h", "at", "chars", "hot", "held", "sure", "seeks")}
        for doc_id, lines in zip(batch.column("doc_id").to_pylist(), batch.column("lines").to_pylist()):
            lines.sort(key=lambda x: x["at"])
            sequence = sorted((i, x["h"]) for x in lines for i in x["at"])
            out["sig"].append(xxhash.xxh3_128_digest(np.array([h for _, h in sequence], np.int64).tobytes()))
            held = [x["first_id"] < doc_id for x in lines]
            chars = {i: x["chars"] for x, y in zip(lines, held) if y for i in x["at"]}
            able = set(_filtered(set(chars), chars))
            sure = [y and x["chars"] >= BLOCK_CHARS and (x["hot"] or len(x["at"]) == 1 and x["once_id"] is not None and x["once_id"] < doc_id) for x, y in zip(lines, held)]
            out["seeks"].append([y and not z and not able.isdisjoint(x["at"]) for x, y, z in zip(lines, held, sure)])
            for k in ("h", "at", "chars", "hot"):
                out[k].append([x[k] for x in lines])
            out["held"].append(held)
            out["sure"].append(sure)
        types = {"sig": pa.binary(), "h": pa.list_(pa.int64()), "at": pa.list_(pa.list_(pa.int32())), "chars": pa.list_(pa.int32())}
        yield pa.record_batch([batch.column("doc_id"), batch.column("rk"), *(pa.array(v, types.get(k, pa.list_(pa.bool_()))) for k, v in out.items())], names=["doc_id", "rk", *out])


def hot_blocks(places: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) of the runs of two or more consecutive lines, out of {line: (hash, characters)}, that hold BLOCK_CHARS characters
    but wouldn't without their first or without their last line; every longer run is a union of such ones and of single lines."""
    out = []
    run: list[int] = []
    for i in [*sorted(places), -1]:
        if run and i != run[-1] + 1:
            upto = np.concatenate([[0], np.cumsum([places[k][1] for k in run])])
            n = len(run)
            ends = np.searchsorted(upto, upto[:-1] + BLOCK_CHARS)  # the least end for each start
            begins = np.searchsorted(upto, upto[1:] - BLOCK_CHARS, side="right") - 1  # the last start for each end
            spans = {(a, int(e) - 1) for a, e in enumerate(ends) if e <= n} | {(int(b), e) for e, b in enumerate(begins) if b >= 0}
            out += [(run[a], run[e]) for a, e in sorted(spans) if e > a]
            run = []
        run.append(i)
    return out


def _blocks(batches):
    for batch in batches:
        us, docs, rks, firsts, lasts = [], [], [], [], []
        for doc_id, rk, h, at, chars, hot in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "rk", "h", "at", "chars", "hot"))):
            if not any(x and c < BLOCK_CHARS for x, c in zip(hot, chars)):
                continue
            places = {i: (k, c) for k, x, c, y in zip(h, at, chars, hot) if y for i in x}
            for a, e in hot_blocks(places):
                us.append(xxhash.xxh3_64_intdigest(np.array([places[i][0] for i in range(a, e + 1)], np.int64).tobytes()) - (1 << 63))
                docs.append(doc_id)
                rks.append(rk)
                firsts.append(a)
                lasts.append(e)
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(docs, pa.int64()), pa.array(rks, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["u", "doc_id", "rk", "a", "e"])


def _pairs(batches):
    for batch in batches:
        gone = []
        for h, at, chars, eh, eat in zip(*(batch.column(k).to_pylist() for k in ("h", "at", "chars", "eh", "eat"))):
            other = dict(zip(eh, eat))
            gone.append(sorted(_aligned([(x, other[k], c) for k, x, c in zip(h, at, chars) if k in other])))
        yield pa.record_batch([batch.column("doc_id"), batch.column("rk"), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "rk", "lines"])


def _masks(batches):
    for batch in batches:
        docs, rks, masks = [], [], []
        names = ("doc_id", "rk", "copy", "at", "chars", "held", "sure", "h", "most", "aligned", "blocks")
        for doc_id, rk, copy, at, chars, held, sure, h, most, aligned, blocks in zip(*(batch.column(k).to_pylist() for k in names)):
            counts = {x["h"]: x["m"] for x in most or ()}
            gone = set(aligned or ())
            for x in blocks or ():
                gone.update(range(x["a"], x["e"] + 1))
            for k, x, y, z in zip(h, at, held, sure):
                gone.update(x if copy or z else x[: counts.get(k, 0)] if y else ())
            out = _filtered(gone, {i: c for x, c in zip(at, chars) for i in x})
            if out:
                mask = np.zeros(out[-1] + 1, bool)
                mask[out] = True
                docs.append(doc_id)
                rks.append(rk)
                masks.append(mask.tolist())
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(rks, pa.int64()), pa.array(masks, pa.list_(pa.bool_()))], names=["id", "key", "gone"])


def _row_key() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def common_blocks(docs: DataFrame) -> DataFrame:
    """(id, key, gone): for documents that lose lines, a mask over their lines; key is xxhash64 of id and text.

    The result is that of aligning each document with every earlier one that shares a rare line, and of looking up hot
    blocks. Of the pairs only these are formed, at most RARE for a line of a document:
    - of rows with the same sequence of shared lines, the first is a partner for all; the later ones lose them all;
    - a line of BLOCK_CHARS characters that stands once here and once in an earlier document, or that is hot, goes in any
      case, and one in a run of held lines that is too short never does; partners are sought for rows with other lines only;
    - a partner with one common line takes its first occurrences, as many as it has itself.
    Hot lines form no pairs: their blocks are hashed and looked up, with work in proportion to the lines.
    """
    lines = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("rk"), F.col("text").cast("string").alias("text"))
        .where("doc_id is not null and text is not null and text <> ''")
        .mapInArrow(_lines, _LINE_SCHEMA)
    )
    known = (
        lines.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.min(F.when(F.size("at") == 1, F.col("doc_id"))).alias("once_id"), (F.count("*") > RARE).alias("hot"))
        .where("first_id < last_id").drop("last_id")
    )
    shared = lines.join(known, "h").groupBy("rk", "doc_id").agg(F.collect_set(F.struct("h", "at", "chars", "first_id", "once_id", "hot")).alias("lines"))
    rows = written(shared.mapInArrow(_rows, _ROW_SCHEMA), "rows")
    firsts = rows.groupBy("sig").agg(F.min(F.struct("doc_id", "rk")).alias("first"))
    rows = written(rows.join(firsts, "sig").withColumn("copy", F.col("doc_id") > F.col("first.doc_id")).withColumn("one", (F.col("doc_id") == F.col("first.doc_id")) & (F.col("rk") == F.col("first.rk"))).drop("sig", "first"), "marked")
    placed = rows.where(F.exists("hot", lambda x: x)).select("doc_id", "rk", "h", "at", "chars", "hot").mapInArrow(_blocks, "u long, doc_id long, rk long, a int, e int")
    again = placed.groupBy("u").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    blocks = placed.join(again, "u").where("first_id < doc_id").groupBy("doc_id", "rk").agg(F.collect_list(F.struct("a", "e")).alias("blocks"))
    holders = rows.where("one").select(F.col("doc_id").alias("e_id"), F.col("rk").alias("e_rk"), F.explode(F.arrays_zip("h", "at", "hot")).alias("x")).where("not x.hot").select("e_id", "e_rk", "x.h", F.size("x.at").alias("m"))
    seekers = (
        rows.where(~F.col("copy") & F.exists("seeks", lambda x: x))
        .select("doc_id", "rk", F.exists("hot", lambda x: x).alias("warm"), F.exists(F.zip_with("hot", "seeks", lambda x, y: x & y), lambda x: x).alias("all"), F.explode(F.arrays_zip("h", "held", "seeks", "hot")).alias("x"))
        .where("x.held and not x.hot").select("doc_id", "rk", "warm", "x.h", (F.col("x.seeks") | F.col("all")).alias("seeks"))
    )
    pairs = written(
        seekers.join(holders, "h").where("e_id < doc_id")
        .groupBy("doc_id", "rk", "e_id", "e_rk").agg(((F.count("*") == 1) & ~F.max("warm")).alias("single"), F.max("seeks").alias("seeks"), F.max("h").alias("h"), F.max("m").alias("m"))
        .where("seeks").drop("seeks"),
        "pairs",
    )
    most = pairs.where("single").groupBy("doc_id", "rk", "h").agg(F.max("m").alias("m")).groupBy("doc_id", "rk").agg(F.collect_list(F.struct("h", "m")).alias("most"))
    aligned = (
        pairs.where("not single").select("doc_id", "rk", "e_id", "e_rk")
        .join(rows.where(~F.col("copy")).select("doc_id", "rk", "h", "at", "chars"), ["doc_id", "rk"])
        .join(rows.where("one").select(F.col("doc_id").alias("e_id"), F.col("rk").alias("e_rk"), F.col("h").alias("eh"), F.col("at").alias("eat")), ["e_id", "e_rk"])
        .mapInArrow(_pairs, "doc_id long, rk long, lines array<int>")
        .select("doc_id", "rk", F.explode("lines").alias("line"))
        .groupBy("doc_id", "rk").agg(F.collect_set("line").alias("aligned"))
    )
    told = rows.join(most, ["doc_id", "rk"], "left").join(aligned, ["doc_id", "rk"], "left").join(blocks, ["doc_id", "rk"], "left")
    return told.mapInArrow(_masks, "id long, key long, gone array<boolean>")


def dedup_lines(docs: DataFrame, count: str = "__lines_gone") -> DataFrame:
    """docs with the cleaned text in place of text, and the number of lines deleted in a column named by ``count``.

    The lines of a document are its text split at line feeds, compared without outer white space;
    blank lines are never compared. A document is aligned by patience diff with every earlier one
    (lower doc_id) that shares a rare line with it, one that at most RARE documents hold, on all lines
    the two share; blocks that moved are added. Lines that more documents hold are hot: a block of
    consecutive hot lines goes from every document but the first that holds it. What is common in
    either way goes from the later document in runs of consecutive lines with at least BLOCK_CHARS
    characters. All decisions rest on the original texts.

    A null text, an empty one, and rows without doc_id stay as they are (0 lines gone) and are no
    partners. Rows with the same doc_id are never each other's partner. Repeated rows are all
    cleaned alike. A text that is deleted whole becomes empty. An empty table gives no rows. Other
    columns are passed through, whatever their names; one named as ``count`` is replaced.
    """
    names = [c for c in docs.columns if c.lower() != count.lower()]
    row, id_, key, gone = free_names(docs, "row", "id", "key", "gone")
    cut = common_blocks(docs).withColumnsRenamed({"id": id_, "key": key, "gone": gone})
    kept = F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.coalesce(F.get(F.col(gone), i), F.lit(False)))
    return (
        docs.withColumn(row, _row_key())
        .join(cut, (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(row) == F.col(key)), "left")
        .select(
            *[F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
            F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(gone, lambda x: x))).alias(count),
        )
    )
