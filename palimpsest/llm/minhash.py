"""Near-duplicate groups by MinHash with banding, signature verification and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import U64, buffers, free_names, grouped, mix, word_hashes, written
from palimpsest.llm.components import components

#: Words in a shingle; hash minima of a signature, as bands times rows; share of equal minima that links two documents.
SHINGLE, BANDS, ROWS, ALIKE = 3, 40, 4, 0.5
MINIMA = BANDS * ROWS
#: Nodes of a bucket that one task compares; a larger bucket is cut into such pieces first, and then by further minima.
SPLIT = 50_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64)[:, None]
_B = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64)[:, None]
_BAND_SEED = mix(np.arange(1, BANDS + 1, dtype=U64))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the runs of k words; of all words if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint32)
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, U64)
    for j in range(k):
        out = out * U64(0x100000001B3) + words[j : len(words) - k + 1 + j]
    return (mix(out) >> U64(32)).astype(np.uint32)


def signature(sh: np.ndarray) -> np.ndarray:
    """The minima over the shingles of the upper 32 bits of a*x+b modulo 2**64, one for each (a, b): multiply-shift, which is strongly universal on 32-bit x."""
    least, wide = np.full(MINIMA, 0xFFFFFFFFFFFFFFFF, U64), sh.astype(U64)
    for at in range(0, len(sh), 512):
        np.minimum(least, (_A * wide[None, at : at + 512] + _B).min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32)


def _sign(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(pc.utf8_lower(batch.column("text")))
        words, at = word_hashes(data, offsets)
        rows = np.flatnonzero(np.diff(at) > 0)
        sigs = np.empty((len(rows), MINIMA), np.uint32)
        for i, r in enumerate(rows):
            sigs[i] = signature(shingles(words[at[r] : at[r + 1]]))
        parts = sigs.reshape(len(rows), BANDS, ROWS).astype(U64)
        keys = np.zeros((len(rows), BANDS), U64) + _BAND_SEED
        for j in range(ROWS):
            keys = mix(keys + parts[:, :, j])
        whole = np.zeros(len(rows), U64)
        for j in range(BANDS):
            whole = mix(whole * U64(31) + keys[:, j])
        low = np.ascontiguousarray(sigs.astype(np.uint16)).view(np.uint8).reshape(-1)
        yield pa.record_batch(
            [
                batch.column("doc_id").take(pa.array(rows)),
                batch.column("rk").take(pa.array(rows)),
                pa.array(whole.view(np.int64)),
                pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * MINIMA * 2).astype(np.int32)), pa.py_buffer(low)]),
                pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * BANDS).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
            ],
            names=["doc_id", "rk", "node", "sig", "bands"],
        )


def links(sigs: np.ndarray, least: float = ALIKE) -> list[tuple[int, int]]:
    """Edges (from the first of a group) that join the rows connected by pairs with at least this share of equal minima.

    Every row is compared with all rows not yet reached, so the groups are those of all pairs.
    """
    need = int(np.ceil(least * sigs.shape[1] - 1e-9))
    left, out = np.arange(len(sigs)), []
    while len(left) > 1:
        first, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            me = sigs[queue.pop()]
            near = np.concatenate([np.count_nonzero(sigs[left[i : i + 4096]] == me, axis=1) for i in range(0, len(left), 4096)]) >= need
            got = left[near]
            out += [(first, x) for x in got]
            queue += got.tolist()
            left = left[~near]
    return out


def _verify(batches):
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def flush():
        out = pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        a.clear()
        b.clear()
        return out

    for group in grouped(batches, "bucket"):
        nodes = group.column("node").to_numpy()
        raw = b"".join(group.column("sig").to_pylist())
        sigs = np.frombuffer(raw, np.uint16).reshape(len(nodes), MINIMA)
        if found := links(sigs):
            pair = np.array(found)
            a.append(nodes[pair[:, 0]])
            b.append(nodes[pair[:, 1]])
            if len(a) > 5000:
                yield flush()
    if a:
        yield flush()


def _chunks(split: int):
    """Out of rows sorted by key and node: (key, used, nodes, whole) for each key with several nodes, in pieces of at most split.

    whole is false where a key may have more rows elsewhere: in a piece, and in the first and last key of a partition.
    """

    def run(batches):
        key, used, node = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut, first = None, True

        def rows(keys, useds, nodes, sizes, whole):
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.record_batch([pa.array(keys), pa.array(useds), pa.ListArray.from_arrays(pa.array(at), pa.array(nodes)), pa.array(whole)], names=["key", "used", "nodes", "whole"])

        for batch in batches:
            key, used, node = (np.concatenate([old, batch.column(k).to_numpy()]) for old, k in ((key, "key"), (used, "used"), (node, "node")))
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            last = int(starts[-1])
            if last:
                begins, sizes = starts[:-1], np.diff(starts)
                part = np.array([(k == cut) or (first and i == 0) for i, k in enumerate(key[begins[:1]])] + [False] * (len(begins) - 1))
                keep = (sizes > 1) | part
                small = keep & (sizes <= split)
                if small.any():
                    yield rows(key[begins[small]], used[begins[small]], node[:last][np.repeat(small, sizes)], sizes[small], ~part[small])
                for b, n in zip(begins[keep & (sizes > split)].tolist(), sizes[keep & (sizes > split)].tolist()):
                    for at in range(b, b + n, split):
                        end = min(b + n, at + split)
                        yield rows(key[b : b + 1], used[b : b + 1], node[at:end], [end - at], [False])
                key, used, node, first = key[last:], used[last:], node[last:], False
            while len(key) > split:
                yield rows(key[:1], used[:1], node[:split], [split], [False])
                cut, key, used, node = key[0], key[split:], used[split:], node[split:]
        if len(key):
            yield rows(key[:1], used[:1], node, [len(node)], [False])

    return run


#: As two linked nodes agree in need of all minima, they agree in one at least of any MINIMA - need + 1.
_NEED = int(np.ceil(ALIKE * MINIMA - 1e-9))
_TURN = np.random.default_rng(7).permutation(MINIMA)


#: Further minima by which a large bucket is cut one after the other, at most; what is large even then is searched whole.
_DEEPEST = 2


def _finer(batches):
    """Each row under a key for each of as many further minima, none of them used so far, as any pair of linked nodes must agree in one of.

    used holds the band in its lowest 6 bits and the minima used since in 8 bits each.
    """
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, MINIMA)
        keys, used = batch.column("key").to_numpy().view(U64), batch.column("used").to_numpy()
        node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
        for past in np.unique(used).tolist():
            some = np.flatnonzero(used == past)
            gone = [(past >> at & 255) - 1 for at in range(6, 62, 8) if past >> at]
            free = [p for p in _TURN.tolist() if p // ROWS != past & 63 and p not in gone]
            for p in free[: MINIMA - _NEED + 1]:
                finer = mix(mix(keys[some] + U64(p + 1)) + sigs[some, p].astype(U64))
                now = past | (p + 1) << 6 + 8 * len(gone)
                yield pa.record_batch([pa.array(finer.view(np.int64)), pa.array(np.full(len(some), now, np.int64)), pa.array(node[some]), pa.array(root[some])], names=["key", "used", "node", "root"])


def _compared(members: DataFrame, nodes: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """(links, big): links between nodes that share a key, and (key, used, node) of the keys with more than split nodes, of which only pieces were compared.

    Rows are cut into ranges of key and node, so that a key with most of the nodes is many tasks' work.
    """
    chunks = written(members.select("key", "used", "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_chunks(split), "key long, used long, nodes array<long>, whole boolean"), "chunks")
    parts = chunks.where("not whole")
    sizes = written(parts.groupBy("key").agg(F.sum(F.size("nodes")).alias("n")), "sizes")
    few = parts.join(sizes.where(F.col("n") <= split), "key").groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("nodes"))).alias("nodes"))
    large = parts.join(sizes.where(F.col("n") > split).select("key"), "key", "left_semi")
    buckets = chunks.where("whole").select("nodes").unionByName(few.select("nodes")).unionByName(large.select("nodes")).where(F.size("nodes") > 1).distinct()
    pairs = (
        buckets.select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"))
        .join(nodes.select("node", "sig"), "node")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "node")
        .mapInArrow(_verify, "a long, b long")
    )
    return written(pairs, "links"), large.select("key", "used", F.explode("nodes").alias("node"))


def _roots(nodes: DataFrame, split: int) -> DataFrame:
    """(node, root) as components() gives them, for the links of all pairs of nodes that share a band.

    Buckets of at most split nodes are searched whole. A larger one is searched in pieces; if these don't make it one
    component, its nodes meet again by further minima: linked nodes agree in half of them, so in one of any
    half and one more, and no link is lost. That goes on until no bucket is large, or _DEEPEST minima are used.
    """
    members = nodes.select("node", F.posexplode("bands").alias("used", "key")).select("key", F.col("used").cast("long").alias("used"), "node")
    links, large = _compared(members, nodes, split)
    roots = components(links, "a", "b")
    depth = 0
    while large.take(1):
        depth += 1
        told = written(large.join(roots, "node", "left").select("key", "used", "node", F.coalesce("root", "node").alias("root")), "large")
        mixed = told.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        finer = written(told.join(mixed, "key", "left_semi").join(nodes.select("node", "sig"), "node").mapInArrow(_finer, "key long, used long, node long, root long"), "finer")
        still = finer.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        more, large = _compared(finer.join(still, "key", "left_semi"), nodes, split if depth < _DEEPEST else 1 << 31)
        links = links.unionByName(more)
        roots = components(links, "a", "b")
    return roots


def _grouped_rows(docs: DataFrame, split: int) -> DataFrame:
    """(doc_id, rk, key): rows with words and the key of their group; rk is a hash of id and text."""
    signed = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("rk"), F.col("text").cast("string").alias("text"))
        .where("text is not null")
        .mapInArrow(_sign, "doc_id long, rk long, node long, sig binary, bands array<long>"),
        "signed",
    )
    nodes = written(signed.groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    return written(signed.select("doc_id", "rk", "node").distinct().join(_roots(nodes, split), "node", "left").select("doc_id", "rk", F.coalesce("root", "node").alias("key")), "groups")


def _row_key() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc_id, rep_doc_id, group_size): each document with a near copy of lower doc_id, and the least doc_id of its group.

    Documents are linked if at least ALIKE of their MINIMA hash minima over word triples agree;
    a group is a connected component of the links. Equal signatures form one node first, so exact
    copies cost one row each, whatever their number. Nodes that share a band are candidates; each
    bucket is searched for all its links, whatever its size; one of more than ``split`` nodes is cut up for it without losing any.

    Null or wordless texts and rows without doc_id are in no group. Rows that repeat a doc_id
    count once in group_size and never make a pair with themselves. Ties go to the least doc_id.
    An empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """
    rows = _grouped_rows(docs.where("doc_id is not null"), split)
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep_doc_id"), F.count_distinct("doc_id").alias("group_size")).where("group_size > 1")
    return rows.join(reps, "key").where("doc_id <> rep_doc_id").select("doc_id", "rep_doc_id", "group_size").distinct()


def drop_near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """docs with one row of each group of near duplicates, grouped as in near_duplicates() but by rows.

    The row of least doc_id stays, of several the one whose text has the least hash; rows without
    doc_id come after all others. Rows that share a doc_id are judged each by its own text. Of rows that
    agree in doc_id and text one stays, nulls being equal; null and wordless texts are in no other
    group. An empty table gives no rows. Columns as in docs, whatever their names.

    What goes is written first, so that Spark knows its size when it joins: texts are shuffled only
    if that is too large to broadcast, and if no row is repeated they are read just once.
    """
    id_, key, n, row = free_names(docs, "copy_id", "copy_key", "copies", "row_key")
    rows = _grouped_rows(docs, split)
    order = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "rk")
    reps = rows.groupBy("key").agg(F.min(order).alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = written(rows.join(reps, "key").where(~(F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("rk") == F.col("rep.rk")))).select(F.col("doc_id").alias(id_), F.col("rk").alias(key)), "copies")
    repeated = written(docs.select(_row_key().alias(key)).groupBy(key).agg(F.count("*").alias(n)).where(f"`{n}` > 1").select(key), "repeated")
    keyed = docs.withColumn(row, _row_key())
    kept = keyed.join(copies, (F.col(row) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_anti")
    if not repeated.take(1):
        return kept.drop(row)
    again = kept.join(repeated, F.col(row) == F.col(key), "left_semi").dropDuplicates([row, "doc_id", "text"])
    return kept.join(repeated, F.col(row) == F.col(key), "left_anti").unionByName(again).drop(row)
