"""Where lines come from: the history of each file is replayed as line edits over a piece table.

Besides blame, the replay keeps for every token its live occurrences and a set of commits the way
a lazy indexer does (*compat*): a commit is added when a token comes, and the gap up to its end is
filled when the token goes, when the file goes, or at the head. That set differs from presence()
at the last commit before a removal and around repeated additions; search uses presence().
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text

Place = tuple[int, int]


class Pieces:
    """The lines of a file as pieces (lines, commit, first line in that commit)."""

    def __init__(self, commit: int | None = None, lines: int = 0):
        self.pieces: list[tuple[int, int, int]] = [(lines, commit, 0)] if lines else []
        self._ends: list[int] | None = None

    @classmethod
    def of(cls, ends: list[int], origins: list[Place]) -> "Pieces":
        out = cls()
        out.pieces = [(e - b, c, s) for e, b, (c, s) in zip(ends, [0, *ends], origins)]
        return out

    def ends(self) -> list[int]:
        """Where each piece ends; kept until an edit."""
        if self._ends is None:
            self._ends = list(accumulate(n for n, _, _ in self.pieces))
        return self._ends

    def origins(self) -> list[Place]:
        return [(c, s) for _, c, s in self.pieces]

    def piece_at(self, line: int) -> int:
        """The number of the piece with a line, by bisection; the number of pieces if it is beyond the end, 0 if there is none."""
        return bisect_right(self.ends(), line)

    def origin(self, line: int) -> Place:
        k = self.piece_at(line)
        n, c, s = self.pieces[k]
        return c, s + line - (self.ends()[k] - n)

    def _cut(self, line: int) -> int:
        """Makes a piece begin at a line; its number."""
        k = self.piece_at(line)
        if k == len(self.pieces):
            if line != (at := self.ends()[-1] if k else 0):
                raise ValueError(f"line {line} is beyond the end, {at}")
            return k
        n, c, s = self.pieces[k]
        into = line - (self.ends()[k] - n)
        if not into:
            return k
        self.pieces[k : k + 1] = [(into, c, s), (n - into, c, s + into)]
        self._ends = None
        return k + 1

    def add(self, line: int, n: int, origin: Place) -> None:
        """n lines that origin brought in, before ``line``."""
        if n:
            self.pieces.insert(self._cut(line), (n, *origin))
            self._ends = None

    def delete(self, line: int, n: int) -> list[tuple[int, int, int]]:
        """Removes n lines from ``line`` on; (commit, first line, line after the last) of what went, in order."""
        if not n:
            return []
        a = self._cut(line)
        b = self._cut(line + n)
        gone = [(c, s, s + k) for k, c, s in self.pieces[a:b]]
        del self.pieces[a:b]
        self._ends = None
        return gone

    def delete_all(self) -> list[tuple[int, int, int]]:
        return self.delete(0, sum(n for n, _, _ in self.pieces))


def lines_of(content: str) -> list[str]:
    """The lines of a text as text.lines() has them."""
    if not content:
        return []
    out = content.replace("\r\n", "\n")
    return (out[:-1] if out.endswith("\n") else out).split("\n")


@dataclass(slots=True)
class Token:
    """Live occurrences of a token, and the commits it is said to be in, as runs (first, last) in order and with gaps between them."""

    live: set[Place] = field(default_factory=set)
    runs: list[Place] = field(default_factory=list)

    @property
    def commits(self) -> set[int]:
        return {c for first, last in self.runs for c in range(first, last + 1)}

    def add(self, commit: int) -> None:
        if not self.runs or commit > self.runs[-1][1] + 1:
            self.runs.append((commit, commit))
            return
        first, last = self.runs[-1]
        if commit < first:  # out of order
            later, self.runs = self.runs, []
            for a, b in sorted([*later, (commit, commit)]):
                self.add(a)
                self.fill(b + 1)
        elif commit > last:
            self.runs[-1] = (first, commit)

    def fill(self, end: int) -> None:
        """All commits from the last one up to, but without, the end."""
        first, last = self.runs[-1]
        if end - 1 > last:
            self.runs[-1] = (first, end - 1)


@dataclass
class Replay:
    """The state of one file: its lines and their origins, its tokens (if indexed), the commits that changed it."""

    lines: list[str] = field(default_factory=list)
    pieces: Pieces = field(default_factory=Pieces)
    tokens: dict[str, Token] = field(default_factory=dict)
    modified: set[int] = field(default_factory=set)
    deleted: bool = False
    indexed: bool = True

    def _remove(self, commit: int, line: int, old: list[str]) -> None:
        self.modified.add(commit)
        spans = self.pieces.delete(line, len(old))
        if not self.indexed:
            return
        places = [(c, k) for c, a, b in spans for k in range(a, b)]
        gone: dict[str, set[Place]] = {}
        for place, content in zip(places, old):
            for t in dict.fromkeys(text.literal_tokens(content)):
                if (where := gone.get(t)) is None:
                    gone[t] = {place}
                else:
                    where.add(place)
        for t, where in gone.items():
            token = self.tokens[t]
            token.live -= where
            if not token.live:
                if token.runs:
                    token.fill(commit - 1)
                else:
                    token.add(commit - 1)

    def step(self, commit: int, content: str | None) -> None:
        """What a commit made of the file; null deletes it. Hunks are applied from the last to the first, so line numbers hold."""
        if content is None:
            if self.lines:
                self.modified.add(commit)
                self.deleted = True
                for token in self.tokens.values():
                    if token.live:
                        token.fill(commit)
                        token.live.clear()
                self.pieces.delete_all()
            self.lines = []
            return
        new = lines_of(content)
        for kind, a0, a1, b0, b1 in reversed(SequenceMatcher(None, self.lines, new, autojunk=False).get_opcodes()):
            if kind == "equal":
                continue
            if a1 > a0:
                self._remove(commit, a0, self.lines[a0:a1])
            if b1 > b0:
                self._add(commit, a0, b0, new[b0:b1])
        self.lines = new

    def _add(self, commit: int, at: int, line: int, new: list[str]) -> None:
        """Lines that come before the present line ``at`` and are from ``line`` on in the new version."""
        self.pieces.add(at, len(new), (commit, line))
        self.modified.add(commit)
        for k, content in enumerate(new if self.indexed else ()):
            place, now = (commit, line + k), (commit, commit)
            for t in dict.fromkeys(text.literal_tokens(content)):
                token = self.tokens.get(t)
                if token is None:
                    self.tokens[t] = Token({place}, [now])
                else:
                    token.live.add(place)
                    token.add(commit)

    def finish(self, head: int) -> None:
        """Live tokens are in every commit up to the head."""
        for token in self.tokens.values():
            if token.live:
                token.fill(head + 1)


BLAME = "path string, line_no int, line string, intro_commit long, intro_line int"
GROUPS = "path string, firsts array<long>, lasts array<long>, is_deleted boolean, tokens array<string>, n_live array<int>"
DETAILS = ", live array<array<struct<intro_commit:long,intro_line:int>>>, modified array<long>"
#: Tokens of finished files that a task gives out at once.
MOST_TOKENS = 1 << 16


def _replayed(rows: pd.DataFrame) -> Replay:
    r = Replay(indexed=False)
    for commit, content in rows.sort_values("commit_index")[["commit_index", "content"]].itertuples(index=False):
        r.step(int(commit), None if content is None or content != content else content)
    return r


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, Replay]]:
    """Each path with its replay at the head, from batches of (path, commit_index, content, head) in the order of path and commit; one file is held at a time."""
    r = path = head = None
    for b in batches:
        for p, commit, content, h in zip(*(c.to_pylist() for c in b.columns)):
            if r is None or p != path:
                if r is not None:
                    r.finish(head)
                    yield path, r
                r, path, head = Replay(), p, h
            r.step(commit, content)
    if r is not None:
        r.finish(head)
        yield path, r


def _grouped(details: bool):
    """The tokens of a file that are in the same commits as one row, for mapInArrow."""
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32())]
    if details:
        kinds += [pa.list_(pa.list_(pa.struct([("intro_commit", pa.int64()), ("intro_line", pa.int32())]))), pa.list_(pa.int64())]
    names = [c.split()[0] for c in (GROUPS + DETAILS * details).split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for path, r in _files(batches):
            same: dict[tuple[Place, ...], list[str]] = {}
            for t, x in r.tokens.items():
                same.setdefault(tuple(x.runs), []).append(t)
            for runs, tokens in same.items():
                live = [r.tokens[t].live for t in tokens]
                more = ([[{"intro_commit": c, "intro_line": k} for c, k in sorted(x)] for x in live], sorted(r.modified)) if details else ()
                rows.append((path, [a for a, _ in runs], [b for _, b in runs], r.deleted, tokens, [len(x) for x in live], *more))
                n += len(tokens)
                if n >= MOST_TOKENS:
                    yield batch(rows)
                    rows, n = [], 0
        if rows:
            yield batch(rows)

    return run


def compat_groups(versions: DataFrame, details: bool = False) -> DataFrame:
    """The replayed token index of every file at the head (columns of GROUPS, with details those of DETAILS): tokens of a file that are in the same commits are one row, which has the runs of these commits.

    Files are replayed one after the other in the order of path and commit, so a task holds one file at a time, and no commit of a run is spelled out.
    """
    rows = versions.select("path", "commit_index", "content", "head").repartition("path").sortWithinPartitions("path", "commit_index")
    return rows.mapInArrow(_grouped(details), GROUPS + DETAILS * details)


def commits_of(firsts: str, lasts: str) -> Column:
    """The commits of some runs."""
    return F.flatten(F.zip_with(firsts, lasts, lambda a, b: F.sequence(a, b)))


def blame(versions: DataFrame) -> DataFrame:
    """(path, line_no, line, intro_commit, intro_line): for every line of the last version of each live file, the commit that brought it and its place there.

    One group is the history of one file.
    """

    def lines(rows: pd.DataFrame) -> pd.DataFrame:
        r = _replayed(rows)
        at = [(c, s + k) for n, c, s in r.pieces.pieces for k in range(n)]
        return pd.DataFrame([(rows["path"].iloc[0], k, line, c, s) for k, (line, (c, s)) in enumerate(zip(r.lines, at))], columns=["path", "line_no", "line", "intro_commit", "intro_line"])

    return versions.select("path", "commit_index", "content").groupBy("path").applyInPandas(lines, BLAME)


def compat_index(versions: DataFrame) -> DataFrame:
    """(path, token, live, commits, modified, is_deleted): the replayed token index of every file at the head."""
    groups = compat_groups(versions, details=True).select("path", commits_of("firsts", "lasts").alias("commits"), "modified", "is_deleted", F.arrays_zip("tokens", "live").alias("each"))
    return groups.withColumn("t", F.explode("each")).select("path", F.col("t.tokens").alias("token"), "t.live", "commits", "modified", "is_deleted")


def edit_stats(versions: DataFrame) -> DataFrame:
    """(path, n_versions, lines_added, lines_removed): how much each file was edited."""

    def stats(rows: pd.DataFrame) -> pd.DataFrame:
        lines, added, removed = [], 0, 0
        for content in rows.sort_values("commit_index")["content"]:
            new = lines_of(content) if isinstance(content, str) else []
            for kind, a0, a1, b0, b1 in SequenceMatcher(None, lines, new, autojunk=False).get_opcodes():
                if kind != "equal":
                    added, removed = added + b1 - b0, removed + a1 - a0
            lines = new
        return pd.DataFrame([(rows["path"].iloc[0], len(rows), added, removed)], columns=["path", "n_versions", "lines_added", "lines_removed"])

    return versions.select("path", "commit_index", "content").groupBy("path").applyInPandas(stats, "path string, n_versions long, lines_added long, lines_removed long").select("path", "n_versions", F.col("lines_added"), F.col("lines_removed"))
