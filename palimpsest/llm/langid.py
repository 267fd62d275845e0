"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import buffers, free_names

#: Hidden units of each direction; bytes of a window that are labelled, and of the text on either side of it that the state is carried over before.
HIDDEN, WINDOW, MARGIN = 8, 128, 16
#: The bounds on the training sample: labelled documents of each language (at most twice as many), which are cut into windows whole, and labelled windows of each language, drawn from all of them alike; optimiser steps, windows of a step, and bytes of them, from a place drawn each time, through which errors are propagated back.
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, BATCH, SPAN = 400, 4096, 200, 128, 64
#: A document with less pooled probability is rejected.
CONFIDENT = 0.4


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the activation of candidates; gates use (1 + squash) / 2. Works in place."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


@dataclass
class Network:
    """Weights: bytes to gates (256, 3H), state to gates (H, 3H) for either direction, state to classes (2H, C)."""

    classes: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    def states(self, x: np.ndarray, direction: int, keep: bool = False):
        """The state after every byte of x (bytes by windows), and with keep what the backward pass needs."""
        steps, n = x.shape
        hid = self.u[0].shape[0]
        wzr, wn = np.ascontiguousarray(self.w[direction][:, : 2 * hid]), np.ascontiguousarray(self.w[direction][:, 2 * hid :])
        uzr, un = np.ascontiguousarray(self.u[direction][:, : 2 * hid]), np.ascontiguousarray(self.u[direction][:, 2 * hid :])
        h = np.zeros((n, hid), np.float32)
        out = np.empty((steps, n, hid), np.float32)
        tape = []
        zr, hn = np.empty((n, 2 * hid), np.float32), np.empty((n, hid), np.float32)
        g, gn = np.empty_like(zr), np.empty_like(hn)
        for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
            np.take(wzr, x[t], axis=0, out=g, mode="clip")
            np.take(wn, x[t], axis=0, out=gn, mode="clip")
            np.matmul(h, uzr, out=zr)
            zr += g
            squash(zr)
            if keep:
                raw = zr.copy()
            zr *= 0.5
            zr += 0.5
            np.matmul(h, un, out=hn)
            if keep:
                un_h, before = hn.copy(), h.copy()
            hn *= zr[:, hid:]
            hn += gn
            squash(hn)
            if keep:
                tape.append((t, before, raw, zr.copy(), un_h, hn.copy()))
            h -= hn
            h *= zr[:, :hid]
            h += hn
            out[t] = h
        return (out, tape) if keep else out

    def probabilities(self, x: np.ndarray, keep: bool = False):
        """Class probabilities at every position (steps, windows, classes)."""
        a, b = self.states(x, 0, keep), self.states(x, 1, keep)
        fa, fb = (a[0], b[0]) if keep else (a, b)
        hid = self.u[0].shape[0]
        s = fa.reshape(-1, hid) @ self.v[:hid]
        s += fb.reshape(-1, hid) @ self.v[hid:]
        s += self.c
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        p = s.reshape(*x.shape, -1)
        return (p, a, b) if keep else p

    def pooled(self, x: np.ndarray, size: np.ndarray, margin: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For windows in columns of x, so many bytes of each labelled after the margin: sums of the probabilities at these, counts of labels.

        The same as probabilities() with its sums, step by step and without its large arrays.
        """
        steps, n = x.shape
        hid, k = self.u[0].shape[0], len(self.classes)
        inner = range(margin, steps - margin)
        scores = np.empty((steps, k, n), np.float32)
        total, wins = np.zeros((k, n), np.float32), np.zeros((k, n), np.int32)
        z, r, c, gz, gr, gc, y = (np.empty((n, hid), np.float32) for _ in range(7))
        top, e, tot = np.empty(n, np.float32), np.empty((k, n), np.float32), np.empty(n, np.float32)
        full = bool((size == len(inner)).all())
        for direction in (0, 1):
            wz, wr, wc = (np.ascontiguousarray(self.w[direction][:, i * hid : (i + 1) * hid]) for i in range(3))
            uz, ur, uc = (np.ascontiguousarray(self.u[direction][:, i * hid : (i + 1) * hid]) for i in range(3))
            out = np.ascontiguousarray(self.v[direction * hid : (direction + 1) * hid].T)
            h = np.zeros((n, hid), np.float32)
            for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
                b = x[t]
                for gate, g, w, u in ((z, gz, wz, uz), (r, gr, wr, ur)):
                    np.take(w, b, axis=0, out=g, mode="clip")
                    np.matmul(h, u, out=gate)
                    gate += g
                    np.abs(gate, out=y)
                    y += 1
                    gate /= y
                    gate *= 0.5
                    gate += 0.5
                np.take(wc, b, axis=0, out=gc, mode="clip")
                np.matmul(h, uc, out=c)
                c *= r
                c += gc
                np.abs(c, out=y)
                y += 1
                c /= y
                h -= c
                h *= z
                h += c
                if t not in inner:
                    continue
                if direction == 0:
                    np.matmul(out, h.T, out=scores[t])
                    continue
                s = scores[t]
                s += np.matmul(out, h.T, out=e)
                s += self.c[:, None]
                np.maximum.reduce(s, axis=0, out=top)
                np.subtract(s, top, out=e)
                best = e == 0
                np.exp(e, out=e)
                np.add.reduce(e, axis=0, out=tot)
                np.divide(1, tot, out=tot)
                if not full:
                    inside = t < size + margin
                    tot *= inside
                    best &= inside
                e *= tot
                total += e
                wins += best
        return total.T, wins.T

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean cross-entropy over the masked positions, by backpropagation through time."""
        hid = self.u[0].shape[0]
        p, a, b = self.probabilities(x, keep=True)
        steps, n, k = p.shape
        picked = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (steps, n, 1)), axis=2)[..., 0]
        total = max(1.0, float(mask.sum()))
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
        d = p.copy()
        d[:, np.arange(n), y] -= 1
        d *= (mask / total)[..., None]
        flat = d.reshape(-1, k)
        gv = np.vstack([a[0].reshape(-1, hid).T @ flat, b[0].reshape(-1, hid).T @ flat])
        gws, gus = [], []
        for side, (_, tape) in enumerate((a, b)):
            dh_all = d @ self.v[side * hid : (side + 1) * hid].T
            u = self.u[side]
            gw, gu = np.zeros_like(self.w[side]), np.zeros_like(u)
            dh = np.zeros((n, hid), np.float32)
            steps_x, steps_g = [], []
            for t, before, raw, zr, un_h, cand in reversed(tape):
                dh = dh + dh_all[t]
                z, r = zr[:, :hid], zr[:, hid:]
                dz = dh * (before - cand)
                dn = dh * (1 - z) * (1 - np.abs(cand)) ** 2
                dr = dn * un_h
                dzr = np.hstack([dz, dr]) * 0.5 * (1 - np.abs(raw)) ** 2
                dun = dn * r
                gu[:, : 2 * hid] += before.T @ dzr
                gu[:, 2 * hid :] += before.T @ dun
                steps_x.append(x[t])
                steps_g.append(np.hstack([dzr, dn]))
                dh = dh * z + dzr @ u[:, : 2 * hid].T + dun @ u[:, 2 * hid :].T
            at, g = np.concatenate(steps_x), np.concatenate(steps_g)
            order = np.argsort(at, kind="stable")
            at, g = at[order], g[order]
            heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            gw[at[heads]] = np.add.reduceat(g, heads, axis=0)
            gws.append(gw)
            gus.append(gu)
        return [*gws, *gus, gv, flat.sum(axis=0)], loss

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, self.v, self.c]


def fresh(classes: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    new = lambda *s, k=0.3: (rng.normal(size=s) * k).astype(np.float32)
    return Network(classes, [new(256, 3 * hidden), new(256, 3 * hidden)], [new(hidden, 3 * hidden), new(hidden, 3 * hidden)], new(2 * hidden, len(classes)), np.zeros(len(classes), np.float32))


def train(windows: np.ndarray, mask: np.ndarray, labels: np.ndarray, classes: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 0, hidden: int = HIDDEN) -> Network:
    """A network fitted by Adam on windows (rows of byte values) with a class each; batches draw classes evenly, and each step a span of the windows."""
    net = fresh(classes, hidden, seed)
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(labels == k) for k in range(len(classes))]
    m = [np.zeros_like(p) for p in net.params()]
    s = [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, batch // len(by) + 1) for b in by])
        at = int(rng.integers(0, max(1, windows.shape[1] - SPAN + 1)))
        grads, _ = net.gradients(windows[pick, at : at + SPAN].T.astype(np.intp), labels[pick], mask[pick, at : at + SPAN].T.astype(np.float32))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.params(), grads, m, s):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def cut(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, each between margins: byte values (0 beyond a row's ends), bytes within the window, row numbers."""
    lengths = np.diff(offsets)
    count = -(-lengths // window)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * window
    size = np.minimum(window, offsets[row + 1] - start)
    if not len(row):
        return np.zeros((0, window + 2 * margin), np.uint8), size, row
    at = start[:, None] + np.arange(-margin, window + margin)
    inside = (at >= offsets[row][:, None]) & (at < offsets[row + 1][:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8), size, row


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, block: int = 2048, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Mean class probabilities over all positions of each row, and how many positions each class is likeliest at."""
    n, k = len(offsets) - 1, len(net.classes)
    total, wins = np.zeros((n, k)), np.zeros((n, k), np.int64)
    lengths = np.diff(offsets)
    count = np.cumsum(-(-lengths // window))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(count, (count[at - 1] if at else 0) + 4 * block, side="right")))
        lo, hi = offsets[at], offsets[end]
        win, size, row = cut(data[lo:hi], offsets[at : end + 1] - lo, window, margin)
        for b in range(0, len(win), block):
            p, best = net.pooled(np.ascontiguousarray(win[b : b + block].T).astype(np.intp), size[b : b + block], margin)
            np.add.at(total, at + row[b : b + block], p)
            np.add.at(wins, at + row[b : b + block], best)
        at = end
    return total / np.maximum(1, lengths)[:, None], wins


def _windows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            win, size, row = cut(*buffers(one.column("text")))
            for at in range(0, len(win), 8192):
                part = win[at : at + 8192]
                n = len(part)
                yield pa.record_batch(
                    [pa.array(one.column("lang").to_pylist() * n, pa.string()), pa.array(one.column("h").to_pylist() * n, pa.int64()), pa.array(np.arange(at, at + n)), pa.array([w.tobytes() for w in part], pa.binary()), pa.array(size[at : at + n].astype(np.int32))],
                    names=["lang", "h", "nth", "bytes", "size"],
                )


def training_sample(docs: DataFrame, per_class: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS) -> list[tuple[str, bytes, int]]:
    """(label, bytes with margins, bytes within) of at most ``windows`` windows of every label.

    They are drawn by a hash from all windows of the whole texts of at most 2 * per_class documents
    of the label, themselves drawn by a hash of doc_id and text; equal rows count once. Both bounds
    hold whatever is null or repeated. Every label that any text has is in the sample.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h")).where("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    every = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // per_class))])
    chosen = known.where(F.pmod("h", F.try_element_at(every, F.col("lang"))) == 0).groupBy("lang", "h").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cuts = chosen.withColumn("k", nth).where(F.col("k") <= 2 * per_class).select("lang", "h", "text").mapInArrow(_windows, "lang string, h long, nth long, bytes binary, size int")
    drawn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h", "nth"), "h", "nth"))
    rows = cuts.withColumn("k", drawn).where(F.col("k") <= windows).collect()
    return [(r["lang"], bytes(r["bytes"]), r["size"]) for r in sorted(rows, key=lambda r: (r["lang"], r["k"]))]


def fit(docs: DataFrame) -> Network | None:
    """The network for the labels in docs, fitted on training_sample(); None without labelled texts."""
    sample = training_sample(docs)
    if not sample:
        return None
    classes = sorted({x for x, _, _ in sample})
    win = np.frombuffer(b"".join(raw for _, raw, _ in sample), np.uint8).reshape(len(sample), -1)
    return train(win, win > 0, np.array([classes.index(x) for x, _, _ in sample]), classes)


def scored(spark: SparkSession, net: Network) -> object:
    """An Arrow UDF from text to (lang, p, positions, agree): the label, its pooled probability, positions, positions with that label."""
    shared = spark.sparkContext.broadcast(net)
    kind = "lang string, p double, positions long, agree long"

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        data, offsets = buffers(texts)
        p, wins = pooled(model, data, offsets)
        best = p.argmax(axis=1)
        some = np.diff(offsets) > 0
        rows = np.arange(len(best))
        return pa.StructArray.from_arrays(
            [pa.array([model.classes[b] if s else "und" for b, s in zip(best, some)], pa.string()), pa.array(np.where(some, p[rows, best], 0.0)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(np.where(some, wins[rows, best], 0))],
            names=["lang", "p", "positions", "agree"],
        )

    return score.asNondeterministic()


def _verdict(docs: DataFrame) -> Column | None:
    net = fit(docs)
    return None if net is None else scored(docs.sparkSession, net)(F.col("text").cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, p, positions, agree, keep) for every row of docs.

    Texts are read as UTF-8, whole, in windows of WINDOW bytes; the network labels every byte with
    its state carried over from MARGIN bytes before the window and after it, and the
    probabilities of all bytes are averaged. lang is the likeliest label, p its mean, agree the
    number of bytes with that label. keep is false below CONFIDENT. Classes are all values of
    docs.lang that any text has, however rare; a bounded sample of labelled documents trains the
    network (TRAIN_DOCS, TRAIN_WINDOWS), drawing windows of all classes alike.

    A null or empty text is 'und' with p 0 and keep false. Rows with a null lang are labelled but
    train nothing. Ties go to the label that sorts first. Repeated rows and null ids are labelled
    like others. Without labelled texts there is no network: all rows are 'und' with p 0, and keep
    is true for texts that aren't empty, as nothing speaks against them. An empty table gives no
    rows. Other columns are not read.
    """
    said = _verdict(docs)
    if said is None:
        none = F.coalesce(F.col("text") != "", F.lit(False))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang"), F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("positions"), F.lit(0).cast("long").alias("agree"), none.alias("keep"))
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), said.alias("s"))
    return at.select("doc_id", "s.lang", "s.p", "s.positions", "s.agree", (F.col("s.p") >= CONFIDENT).alias("keep"))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of docs that identify() keeps, with the columns of docs, which may have any name besides doc_id, text and lang."""
    said = _verdict(docs)
    if said is None:
        return docs.where("text <> ''")
    (name,) = free_names(docs, "said")
    return docs.select("*", said.alias(name)).where(F.col(name)["p"] >= CONFIDENT).drop(name)
