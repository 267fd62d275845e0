"""Quality rules: logistic regression on hashed word and character n-grams, calibrated, with fixed thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import CHUNK, U64, buffers, mix, word_hashes

#: Bits of the feature hash of words, and as many of characters; lengths of word and character n-grams (characters are UTF-8 bytes).
BITS, WORD_GRAMS, CHAR_GRAMS = 17, (1, 2), (3, 4)
#: The bound on the labelled documents that train (at most twice as many); share of them that calibrates; passes; rate; L2 penalty.
TRAIN_DOCS, HELD_OUT, PASSES, RATE, PENALTY = 2000, 0.25, 120, 0.5, 1e-6
#: Fixed thresholds on the calibrated probability of good quality.
KEEP, REVIEW = 0.5, 0.8

_SIZE = 1 << BITS


def _char_slots(data: np.ndarray, n: int) -> np.ndarray:
    v = data[: len(data) - n + 1].astype(np.uint32)
    for j in range(1, n):
        v |= data[j : len(data) - n + 1 + j].astype(np.uint32) << np.uint32(8 * j)
    v *= np.uint32(0x9E3779B1)
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x85EBCA77 + 2 * n)
    return (v >> np.uint32(32 - BITS)) + np.uint32(_SIZE)


def _word_slots(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return np.zeros(0, np.uint32)
    v = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        v = mix(v * U64(0x100000001B3) + words[j : len(words) - n + 1 + j])
    return (v >> U64(64 - BITS)).astype(np.uint32)


def features(data: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one text: the mean of its word n-grams and the mean of its character n-grams as sparse vectors."""
    words, _ = word_hashes(lower, np.array([0, len(lower)]))
    out_s, out_v = [], []
    for slots in ([_word_slots(words, n) for n in WORD_GRAMS], [_char_slots(data, n) for n in CHAR_GRAMS if len(data) >= n]):
        if slots and len(all_ := np.concatenate(slots)):
            s, c = np.unique(all_, return_counts=True)
            out_s.append(s)
            out_v.append(c / len(all_))
    return (np.concatenate(out_s), np.concatenate(out_v)) if out_s else (np.zeros(0, np.uint32), np.zeros(0))


@dataclass
class Model:
    """Weights of the slots, bias, and the slope and shift that calibrate the score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Uncalibrated log odds of all texts of a batch, a few at a time."""
        out = np.full(len(texts), self.bias)
        raw, at = buffers(texts)
        low, low_at = buffers(pc.utf8_lower(pc.fill_null(texts, "")))
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
            out[lo:hi] += self._part(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], low[low_at[lo] : low_at[hi]], low_at[lo : hi + 1] - low_at[lo])
            lo = hi
        return out

    def _part(self, raw, at, low, low_at) -> np.ndarray:
        words, word_at = word_hashes(low, low_at)
        total = np.zeros(len(at) - 1)
        for grams, seq, edges, slots_of in ((WORD_GRAMS, words, word_at, _word_slots), (CHAR_GRAMS, raw, at, _char_slots)):
            sums, counts = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
            for n in grams:
                if len(seq) < n:
                    continue
                w = self.weights[slots_of(seq, n)].astype(np.float64)
                upto = np.zeros(len(w) + 1)
                np.cumsum(w, out=upto[1:])
                first, last = np.minimum(edges[:-1], len(w)), np.minimum(np.maximum(edges[1:] - n + 1, edges[:-1]), len(w))
                sums += upto[last] - upto[first]
                counts += last - first
            total += sums / np.maximum(1, counts)
        return total

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(texts) + self.shift, -30, 30)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift of the logistic curve of y on z, with smoothed targets, by Newton's method with a weak pull to slope 1."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * z + b)
        r, w = p - t, p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + (a - 1) * 1e-2, r.sum() + b * 1e-2])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(texts: list[str], y: np.ndarray, seed: int = 0) -> Model:
    """Fitted on the texts by Adam over full passes with both classes weighted alike; every fourth text of each class calibrates."""
    y = np.asarray(y, float)
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for k in (0.0, 1.0):
        of = rng.permutation(np.flatnonzero(y == k))
        held[of[: int(len(of) * HELD_OUT)]] = True
    model = Model(np.zeros(2 * _SIZE, np.float32), 0.0)
    fit = np.flatnonzero(~held)
    if not len(fit) or y[fit].min() == y[fit].max():
        rate = (y.sum() + 1) / (len(y) + 2)
        model.bias = float(np.log(rate / (1 - rate)))
        return model
    rows, slots, values = [], [], []
    for r, i in enumerate(fit):
        raw = np.frombuffer(texts[i].encode(), np.uint8)
        low = np.frombuffer(texts[i].lower().encode(), np.uint8)
        s, v = features(raw, low)
        rows.append(np.full(len(s), r))
        slots.append(s.astype(np.int64))
        values.append(v)
    rows, slots, values = np.concatenate(rows), np.concatenate(slots), np.concatenate(values)
    used, cols = np.unique(slots, return_inverse=True)
    t = y[fit]
    weight = np.where(t > 0, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
    w, bias = np.zeros(len(used) + 1), 0.0
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, PASSES + 1):
        z = np.bincount(rows, values * w[cols], minlength=len(fit)) + w[-1]
        r = (_logistic(z) - t) * weight
        g = np.append(np.bincount(cols, values * r[rows], minlength=len(used)) + PENALTY * w[:-1], r.sum())
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-10)
    bias = float(w[-1])
    model.weights[used] = w[:-1]
    model.bias = bias
    at = np.flatnonzero(held)
    if len(at):
        # the calibration odds are for both classes weighted alike, as in the fit; the share of good labels is put back here
        model.slope, model.shift = calibrate(model.scores(pa.array([texts[i] for i in at], pa.string())), y[at])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> list[tuple[int, str, int]]:
    """(id, text, quality) of at most 2 * bound labelled documents, chosen by a hash of doc_id; the labels of a doc_id that disagree count as 0.

    A doc_id with several texts counts with one of them, the one of least hash.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    n = known.count()
    drawn = F.xxhash64("id")
    chosen = known.where(F.pmod(drawn, F.lit(max(1, n // bound))) == 0).orderBy(drawn, "id").limit(2 * bound)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most 2 * bound rows are broadcast
    return [(r["id"], r["text"], int(r["quality"] > 0)) for r in sorted(one.collect(), key=lambda r: r["id"])]


def fitted(sample: list[tuple[int, str, int]]) -> Model:
    """The model of a sample; without any rows, every text has probability 0.5."""
    return train([t for _, t, _ in sample], np.array([q for _, _, q in sample])) if sample else Model(np.zeros(2 * _SIZE, np.float32), 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents."""
    return fitted(labelled_sample(docs, labels))


def scorer(spark: SparkSession, model: Model):
    """An Arrow UDF from text to the calibrated probability of good quality."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.probabilities(texts))

    return probability.asNondeterministic()


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_good, verdict, keep) for every row of docs.

    verdict is 'drop' below KEEP, 'review' below REVIEW, else 'keep'; keep is false for 'drop' and
    for texts that are null, empty or blank, which get p_good 0. Rows with a null doc_id are scored
    too; labels with a null in doc_id or quality are left out, labels without a document are of no
    use. Repeated rows are scored alike. Whole texts are scored. An empty table gives no rows.
    Other columns are not read.
    """
    p = scorer(docs.sparkSession, fit(docs, labels))
    text = F.col("text").cast("string")
    blank = text.isNull() | ~text.rlike(r"\S")
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), p(text).alias("__p"), blank.alias("__blank"))
    said = said.select("doc_id", F.when(F.col("__blank"), 0.0).otherwise(F.col("__p")).alias("p_good"))
    return said.select("doc_id", "p_good", F.when(F.col("p_good") < KEEP, "drop").when(F.col("p_good") < REVIEW, "review").otherwise("keep").alias("verdict"), (F.col("p_good") >= KEEP).alias("keep"))
