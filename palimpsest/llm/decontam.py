"""Benchmark decontamination by Wu-Manber search for runs of words of benchmark items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Words of a test string; items with fewer are one test string.
RUN = 8
#: Bytes of benchmark text for which one set of tables is built, which bounds a worker's memory (some 15 times this) and what is broadcast; a larger benchmark takes a pass for each slice.
SLICE_BYTES = 8_000_000


def normal(text) -> F.Column:
    """Lower case, everything but letters and digits as one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


class WuManber:
    """Block shift tables for many byte strings.

    A window of ``least`` bytes (the shortest pattern, at most 64 for the tables) slides over the
    text. Its last block of bytes says how far it can move: the least distance at which that block
    ends within the first ``least`` bytes of a pattern. At distance 0 the block selects a bucket,
    and each of its patterns is compared directly.

    Patterns are spans of one buffer, so those that overlap there share its bytes. A block is the
    number that its bytes make; shifts are one byte each in a table indexed by its residue, where
    blocks that share a slot have the least of their shifts, which is never too far. Buckets are
    runs of the sorted blocks. So a pattern costs some 100 bytes, and tables are made by whole arrays.
    """

    def __init__(self, patterns: list[bytes]):
        lengths = np.array([len(p) for p in patterns])
        self._build(b"".join(patterns), np.cumsum(lengths) - lengths, lengths, np.arange(len(patterns)))

    @classmethod
    def of(cls, buffer: bytes, starts: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> WuManber:
        """For the spans of a buffer; what is found is told by name."""
        out = cls.__new__(cls)
        out._build(buffer, starts, lengths, names)
        return out

    def _build(self, buffer: bytes, starts: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> None:
        self.buffer = buffer
        self.least = int(min(64, lengths.min()))
        self.block = max(1, min(8, self.least // 2))
        most = self.least - self.block + 1
        self.slots = min(1 << 25, max(1 << 12, 4 * most * len(starts))) | 1
        raw = np.frombuffer(buffer, np.uint8)
        blocks = np.zeros(len(raw) - self.block + 1, np.uint64)
        for j in range(self.block):
            blocks |= raw[j : len(raw) - self.block + 1 + j].astype(np.uint64) << np.uint64(8 * j)
        residues = (blocks % np.uint64(self.slots)).astype(np.uint32)
        shift = np.full(self.slots, most, np.uint8)
        for end in range(self.block, self.least + 1):  # distances go down, so the least one stays
            shift[residues[starts + end - self.block]] = self.least - end
        self.shift = shift.tobytes()
        last = blocks[starts + self.least - self.block]
        order = np.argsort(last, kind="stable")
        self.keys, self.starts, self.lengths, self.names = last[order], starts[order].astype(np.int64), lengths[order].astype(np.int32), names[order]

    def holds(self, text: bytes) -> bool:
        """Whether any pattern occurs in text."""
        return next(self.occurrences(text), None) is not None

    def find(self, text: bytes) -> set[int]:
        """Names of the patterns that occur in text."""
        return set(self.occurrences(text))

    def occurrences(self, text: bytes) -> Iterator[int]:
        """The name of a pattern for each place where it occurs."""
        least, block, shift, slots, number = self.least, self.block, self.shift, self.slots, int.from_bytes
        at, n = least, len(text)
        while at <= n:
            tail = number(text[at - block : at], "little")
            far = shift[tail % slots]
            if far:
                at += far
                continue
            key = np.uint64(tail)
            for k in range(int(self.keys.searchsorted(key)), int(self.keys.searchsorted(key, "right"))):
                s = int(self.starts[k])
                if text.startswith(self.buffer[s : s + int(self.lengths[k])], at - least):
                    yield int(self.names[k])
            at += 1


@dataclass
class Tests:
    """Test strings as spans of the normalised items, with the number of their item and the ids of the items."""

    buffer: bytes
    starts: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    ids: list[int | None]

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], run: int = RUN) -> Tests | None:
        """Each run of words of the items, between spaces, once for every item id; None if there is none."""
        parts, starts, lengths, owner, at = [], [], [], [], 0
        number: dict[int | None, int] = {}
        seen: dict[int, set[bytes]] = {}
        for item, text in items:
            words = [w.encode() for w in text.split()]
            if not words:
                continue
            k = number.setdefault(item, len(number))
            had = seen.setdefault(k, set())
            whole = b" " + b" ".join(words) + b" "
            begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
            for i in range(max(1, len(words) - run + 1)):
                lo, hi = int(begin[i]), int(begin[min(len(words), i + run)]) + 1
                if (string := whole[lo:hi]) not in had:
                    had.add(string)
                    starts.append(at + lo)
                    lengths.append(hi - lo)
                    owner.append(k)
            parts.append(whole)
            at += len(whole)
        return cls(b"".join(parts), np.array(starts), np.array(lengths), np.array(owner, np.int32), list(number)) if starts else None

    def tables(self) -> list[WuManber]:
        """One set of tables for each class of lengths, so that short test strings don't make all shifts short."""
        n, out = self.lengths, []
        for some in (n >= 24, (n >= 8) & (n < 24), n < 8):
            if some.any():
                out.append(WuManber.of(self.buffer, self.starts[some], n[some], np.flatnonzero(some)))
        return out


_made: dict[str, list[WuManber]] = {}


def _tables(name: str, tests: Tests) -> list[WuManber]:
    """The tables of a broadcast; a worker keeps those it used last."""
    if name not in _made:
        while len(_made) >= 2:
            _made.pop(next(iter(_made)))
        _made[name] = tests.tables()
    return _made[name]


def _scan(shared):
    name = uuid.uuid4().hex

    def scan(batches):
        tests = shared.value
        tables = _tables(name, tests)
        for batch in batches:
            docs, items, runs = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer().to_pybytes()
                hits: dict[int | None, int] = {}
                for t in tables:
                    for k in t.find(raw):
                        item = tests.ids[tests.item[k]]
                        hits[item] = hits.get(item, 0) + 1
                docs += [doc_id] * len(hits)
                items += hits.keys()
                runs += hits.values()
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(runs, pa.int32())], names=["doc_id", "item_id", "runs"])

    return scan


def _slices(benchmark: DataFrame) -> Iterator[Tests]:
    """The test strings of the benchmark, in slices of at most about SLICE_BYTES of text each, made one after the other; an item is in one slice."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normal(F.col("text").cast("string")).alias("text")).where("text is not null and length(text) > 2")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // SLICE_BYTES))
    for k in range(slices):
        part = tests if slices == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        if made := Tests.of([(r[0], r[1]) for r in part.collect()]):
            yield made


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, runs): documents that hold test strings of benchmark items, and how many different ones.

    A test string is RUN consecutive words of an item (the whole item if it has fewer words).
    Words are compared in lower case, with anything but letters and digits between them. Whole
    texts are searched for all test strings. The tables are broadcast in slices of at most about
    SLICE_BYTES of benchmark text, so any benchmark fits; beyond the first each slice is one more pass.

    Null or wordless texts and items match nothing. A null doc_id is reported as null, and so is the
    item_id of items without one. Items with the same item_id, or with none, count as one. Repeated document rows
    are each reported. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text").cast("string")).alias("text")).where("text is not null and length(text) > 2")
    found = None
    for tests in _slices(benchmark):
        hits = texts.mapInArrow(_scan(spark.sparkContext.broadcast(tests)), "doc_id long, item_id long, runs int")
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], "doc_id long, item_id long, runs int") if found is None else found


def _holder(shared):
    """An Arrow UDF: whether a normalised text holds any test string; null for null."""
    name = uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        tables = _tables(name, shared.value)
        return pa.array([t.is_valid and any(table.holds(t.as_buffer().to_pybytes()) for table in tables) for t in texts], pa.bool_())

    return holds


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a test string of the benchmark; the columns of docs.

    Each row is judged where it is read, so nothing is shuffled or joined, and ids don't matter:
    rows without doc_id, repeated rows and rows that share a doc_id are judged by their own texts,
    and items without item_id count like others. Null and wordless texts stay. Other columns may
    have any name and nulls. Between the slices of a large benchmark what is left is written, so
    that a worker has the tables of one slice only.
    """
    kept, first = docs, True
    for tests in _slices(benchmark):
        holds = _holder(docs.sparkSession.sparkContext.broadcast(tests))
        kept = (kept if first else written(kept, "decontaminated")).where(~F.coalesce(holds(normal(F.col("text").cast("string"))), F.lit(False)))
        first = False
    return kept
