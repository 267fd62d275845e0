"""A Spark data source over a Git repository: the first-parent history of a branch as rows of changed files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "commit_index long, commit_id string, commit_time timestamp, summary string, path string, change string, content binary"


def _git(repo: str, *args: str, text: bool = True):
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=text).stdout


def commits(repo: str, branch: str = "HEAD") -> list[str]:
    """Commit ids from the oldest to the tip along first parents; an empty repository has none."""
    try:
        return _git(repo, "rev-list", "--first-parent", "--reverse", branch).split()
    except subprocess.CalledProcessError:
        return []


def count(repo: str, branch: str = "HEAD", since: str | None = None) -> int:
    """How many commits an index of the branch, or of what came after the commit ``since``, has to take; for progress."""
    ids = commits(repo, branch)
    return len(ids) - (ids.index(since) + 1 if since in ids else 0)


class _Range(InputPartition):
    def __init__(self, first: int, ids: list[str], before: str | None):
        super().__init__((first, ids[0] if ids else ""))
        self.first, self.ids, self.before = first, ids, before


def _ranges(ids: list[str], first: int, each: int) -> list[_Range]:
    return [_Range(s, ids[s : s + each], ids[s - 1] if s else None) for s in range(first, len(ids), each)] or [_Range(0, [], None)]


def changes(repo: str, commit: str, before: str | None) -> list[tuple[str, str, str]]:
    """(change, path, blob id) of the regular files and links that a commit adds, modifies or deletes; a rename is both."""
    against = [before, commit] if before else ["--root", commit]
    raw = _git(repo, "diff-tree", "-r", "-z", "--no-renames", "--no-commit-id", *against).split("\0")
    out = []
    for head, path in zip(raw[::2], raw[1::2]):
        _, mode, _, blob, kind = head[1:].split(" ")
        if kind == "D":
            out.append(("D", path, ""))
        elif mode != "160000":
            out.append(("A" if kind == "A" else "M", path, blob))
    return out


def rows(repo: str, first: int, ids: list[str], before: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA for consecutive commits; one process hands out all blobs. A commit that changes no file has one row without a path."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as blobs:
        for k, commit in enumerate(ids):
            seconds, summary = _git(repo, "show", "-s", "--format=%ct%x00%s", commit).rstrip("\n").split("\0", 1)
            at = datetime.fromtimestamp(int(seconds), timezone.utc)
            found = changes(repo, commit, before)
            if not found:
                yield (first + k, commit, at, summary, None, None, None)
            for change, path, blob in found:
                content = None
                if blob:
                    blobs.stdin.write(blob.encode() + b"\n")
                    blobs.stdin.flush()
                    size = int(blobs.stdout.readline().split()[2])
                    content = blobs.stdout.read(size + 1)[:-1]
                yield (first + k, commit, at, summary, path, change, content)
            before = commit
        blobs.stdin.close()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.branch = options["path"], options.get("branch", "HEAD")
        self.since, self.each = int(options.get("since", "-1")), int(options.get("commitsPerPartition", "200"))

    def partitions(self):
        return _ranges(commits(self.repo, self.branch), self.since + 1, self.each)

    def read(self, partition: _Range):
        yield from rows(self.repo, partition.first, partition.ids, partition.before)


class _Stream(DataSourceStreamReader):
    """Offsets are counts of commits, so a restarted stream goes on where it was; the tasks read, not the driver."""

    def __init__(self, options: dict):
        self.repo, self.branch, self.each = options["path"], options.get("branch", "HEAD"), int(options.get("commitsPerPartition", "200"))

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(commits(self.repo, self.branch))}

    def partitions(self, start, end):
        ids = commits(self.repo, self.branch)[: end["commits"]]
        return _ranges(ids, start["commits"], self.each)

    def read(self, partition: _Range):
        yield from rows(self.repo, partition.first, partition.ids, partition.before)


class GitHistory(DataSource):
    """Options: path (a repository that all executors see), branch, since (last commit_index already known), commitsPerPartition."""

    @classmethod
    def name(cls):
        return "git_history"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark) -> None:
    spark.dataSource.register(GitHistory)
