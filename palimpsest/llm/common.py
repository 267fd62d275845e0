"""Shared pieces: written tables in the shared folder, Arrow buffers as numpy, hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame

from palimpsest.sources.shared import shared_folder, written

__all__ = ["CHUNK", "U64", "buffers", "free_names", "grouped", "mix", "prefix_hash", "shared_folder", "word_hashes", "written"]

U64 = np.uint64
#: Bytes of text that the vectorised code handles at once; its temporaries are some 60 times this.
CHUNK = 1 << 20


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as it takes to be no column of df, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    if not len(texts):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    step = base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U64(step)
        done += take
        step = step * step & (1 << 64) - 1
    return out


_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _POW or len(_POW["pow"]) < n:
        _POW["pow"], _POW["inv"] = _powers(_BASE, max(n, 2 * CHUNK + 2)), _powers(_INV, max(n, 2 * CHUNK + 2))
    return _POW["pow"], _POW["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit hashes."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash of bytes, and the inverse powers: a span s:e hashes to (sums[e]-sums[s])*inv[s]."""
    power, inv = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    return sums, inv


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about CHUNK bytes that cut no word: they end at a row's end or after a byte that is in no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            row = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
            if row > at:
                end = row
            else:
                while end < n and _WORD[data[end]] and _WORD[data[end - 1]]:
                    end += 1
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-case rows, and per row where its words start among them.

    A word is a run of a-z, 0-9 and bytes from 128 on (so letters beyond ASCII belong to words).
    """
    hashes, starts_all = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    for lo, hi in _pieces(data, offsets):
        part = data[lo:hi]
        inside = _WORD[part]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        head = heads[lo:hi]
        starts = np.flatnonzero(inside & (~before | head))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:] & ~head[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        sums, inv = prefix_hash(part)
        hashes.append(mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64)))
        starts_all.append(starts + lo)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key out of batches that are sorted by it; a group may span batches."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:]):
            part = table.slice(a, b - a)
            if b < len(keys):
                yield pa.concat_tables([*held, part]) if held else part
                held = []
            else:
                held.append(part)
    if held:
        yield pa.concat_tables(held)
