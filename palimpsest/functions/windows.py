"""The distinct tokens of many texts at once, as numbers in Arrow batches: what text.tokens() gives, without a string for each window."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Characters whose windows are made at once; characters that wait to be taken together; (token, path) pairs kept before they are given out.
SLICE, WAITING, KEPT = 1 << 20, 1 << 22, 1 << 21
#: Rows of packed tokens and (token, path) pairs given out at once.
ROWS, GIVEN = 1 << 12, 1 << 16
BITS = 21
PAIRS, EACH, PACKED = "token string, path string", "path string, commit_index long, token string", "path string, part int, tokens binary"
#: The tokens of a path are shuffled in so many parts (a power of two) by hash.
PARTS_BITS = 4


def numbers(text: str) -> np.ndarray:
    """The distinct tokens of a text whose line ends are "\\n": BITS bits for each character, counted from 1; 0 is none."""
    a = np.frombuffer(text.encode("utf-32-le"), "<u4")
    up = lambda x: x.astype(np.uint64) + np.uint64(1)
    out = []
    for at in range(0, len(a) - 2, SLICE):
        x = a[at : at + SLICE + 2]
        end, c = x == 10, up(x)
        w = (c[:-2] << np.uint64(2 * BITS)) | (c[1:-1] << np.uint64(BITS)) | c[2:]
        out.append(pd.unique(w[~(end[:-2] | end[1:-1] | end[2:])]))
    ends = np.concatenate(([-1], np.flatnonzero(a == 10), [len(a)]))
    sizes = np.diff(ends) - 1
    one, two = ends[:-1][sizes == 1] + 1, ends[:-1][sizes == 2] + 1
    out.append(up(a[one]) << np.uint64(2 * BITS))
    out.append((up(a[two]) << np.uint64(2 * BITS)) | (up(a[two + 1]) << np.uint64(BITS)))
    return pd.unique(np.concatenate(out))


def strings(tokens: np.ndarray) -> list[str]:
    """The tokens of some numbers."""
    mask = np.uint64((1 << BITS) - 1)
    c = np.stack([tokens >> np.uint64(2 * BITS), (tokens >> np.uint64(BITS)) & mask, tokens & mask], axis=1)
    held = c > 0
    chars = np.where(held, c - held, 0).astype("<u4").tobytes().decode("utf-32-le")
    out = [chars[k : k + 3] for k in range(0, len(chars), 3)]
    for k in np.flatnonzero(~held[:, 2]):
        out[k] = out[k][: 1 + int(held[k, 1])]
    return out


def _text(content: bytes) -> str:
    """A text with line ends "\n"; broken bytes become what the JVM makes of them, one mark for a surrogate."""
    try:
        out = content.decode()
    except UnicodeDecodeError:
        out = re.sub(rb"\xed[\xa0-\xbf][\x80-\xbf]", "\ufffd".encode(), content).decode("utf-8", "replace")
    return out.replace("\r\n", "\n")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, commit_index, token) for batches of (path, commit_index, content): the distinct tokens of every text."""
    for b in batches:
        rows, found, n = [], [], 0
        for k, content in enumerate(b.column(2).cast(pa.binary())):
            if content.is_valid:
                rows.append(k)
                found.append(numbers(_text(content.as_py())))
                n += len(found[-1])
            if n and (n >= KEPT or k == len(b) - 1):
                at = pa.array(np.repeat(rows, [len(t) for t in found]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(strings(np.concatenate(found)), pa.string())], ["path", "commit_index", "token"])
                rows, found, n = [], [], 0


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, part, tokens) for batches of (path, content): the distinct tokens of a path as numbers, mostly once a task: texts of a path are taken together, as no token crosses a line end.

    At most WAITING characters, or one text, and KEPT pairs beyond those of one path are held.
    """
    waiting: dict[bytes | None, list[str]] = {}
    kept: dict[bytes | None, np.ndarray] = {}
    size = n = 0

    def take() -> None:
        nonlocal n
        for path, texts in waiting.items():
            new, old = numbers("\n".join(texts)), kept.get(path)
            kept[path] = new if old is None else pd.unique(np.concatenate([old, new]))
            n += len(kept[path]) - (0 if old is None else len(old))
        waiting.clear()

    def given() -> Iterator[pa.RecordBatch]:
        paths, parts, tokens = [], [], []
        for path, held in kept.items():
            held = np.sort(held)  # near numbers are alike, which compresses
            part = (held * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARTS_BITS)
            for k in np.unique(part):
                paths.append(path)
                parts.append(int(k))
                tokens.append(held[part == k].astype("<u8").tobytes())
        kept.clear()
        for at in range(0, len(paths), ROWS):
            to = at + ROWS
            # paths go back as the bytes they came as
            yield pa.RecordBatch.from_arrays([pa.array(paths[at:to], pa.binary()).view(pa.string()), pa.array(parts[at:to], pa.int32()), pa.array(tokens[at:to], pa.binary())], ["path", "part", "tokens"])

    for b in batches:
        raw = pa.binary()
        for path, content in zip(b.column(0).cast(raw), b.column(1).cast(raw)):
            if (content := content.as_py()) is None:
                continue
            text = _text(content)
            waiting.setdefault(path.as_py(), []).append(text)
            size += len(text)
            if size >= WAITING:
                take()
                size = 0
                if n >= KEPT:
                    yield from given()
                    n = 0
    take()
    yield from given()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, path) for batches of (path, part, tokens) in the order of path and part: each pair once.

    One part of a path, GIVEN pairs and some KEPT numbers are held.
    """
    key: tuple = ()
    same: list[np.ndarray] = []
    whole: list[tuple[bytes | None, np.ndarray]] = []
    size = n = 0

    def close() -> None:
        nonlocal size, n
        if same:
            whole.append((key[0], pd.unique(np.concatenate(same))))
            n += len(whole[-1][1])
        same.clear()
        size = 0

    def given() -> Iterator[pa.RecordBatch]:
        nonlocal n
        if n:
            at = pa.array(np.repeat(np.arange(len(whole)), [len(t) for _, t in whole]))
            paths = pa.array([p for p, _ in whole], pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(strings(np.concatenate([t for _, t in whole])), pa.string()), paths.take(at)], ["token", "path"])
        whole.clear()
        n = 0

    for b in batches:
        raw = pa.binary()
        for path, part, tokens in zip(b.column(0).cast(raw), b.column(1), b.column(2).cast(raw)):
            at = (path.as_py(), part.as_py())
            if at != key:
                close()
                key = at
                if n >= GIVEN:
                    yield from given()
            same.append(np.frombuffer(tokens.as_py(), "<u8"))
            size += len(same[-1])
            if size >= max(KEPT, len(same[0])):  # a large part isn't gone over again for each row
                same[:] = [pd.unique(np.concatenate(same))]
                size = 0
    close()
    yield from given()


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, path) for batches of (path, content) without a shuffle between: a pair that is given out twice by packed() may come twice."""
    return unpacked(packed(batches))
