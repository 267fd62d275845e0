"""Histories as tables of file changes (path, commit_index, content), and of versions with the commits in which they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.shared import written


def changes(table: DataFrame, path: Column | str, commit: Column | str, content: Column | str, deleted: Column | None = None) -> DataFrame:
    """(path, commit_index, content) for every row of a table that says what a file became in a commit.

    A null content, or a true ``deleted``, is a deletion and has a null content. Rows without path
    or commit are left out. Only columns are chosen, so a search reads no more than it needs.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    text = col(content) if deleted is None else F.when(F.coalesce(deleted, F.lit(False)), F.lit(None)).otherwise(col(content))
    return table.select(col(path).cast("string").alias("path"), col(commit).cast("long").alias("commit_index"), text.cast("string").alias("content")).where("path is not null and commit_index is not null")


def head_of(changes: DataFrame) -> DataFrame:
    """One row (head): the last commit that changed anything."""
    return changes.agg(F.max("commit_index").alias("head"))


def versions(changes: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """(path, commit_index, content, until, head): changes with the time they hold.

    A version holds from commit_index up to but not including ``until``: the commit that next
    changes the file, or head + 1. A deletion ends the version before it.
    """
    following = F.lead("commit_index").over(Window.partitionBy("path").orderBy("commit_index"))
    return changes.withColumn("__next", following).crossJoin(F.broadcast(head_of(changes) if head is None else head)).select("path", "commit_index", "content", F.coalesce("__next", F.col("head") + 1).alias("until"), "head")


def change(versions: DataFrame) -> Column:
    """'A', 'M' or 'D' for each version: the first of a file or after a deletion is added."""
    before = F.lag("content").over(Window.partitionBy("path").orderBy("commit_index"))
    return F.when(F.col("content").isNull(), "D").when(before.isNull(), "A").otherwise("M")


def numbered_commits(commits: DataFrame, order: str, commit_id: str = "commit_id") -> DataFrame:
    """commits, one row for each id, with commit_index, counted from 0 by ``order`` and then by id.

    Ranges are sorted and numbered apart and written; only the ranges' sizes, one row each, are added up in one place.
    """
    one = commits.dropDuplicates([commit_id]).repartitionByRange(order, commit_id).sortWithinPartitions(order, commit_id)
    at = F.monotonically_increasing_id()
    ranges = written(one.withColumns({"__range": F.shiftright(at, 33), "__nth": at.bitwiseAND((1 << 33) - 1)}), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return ranges.join(F.broadcast(starts), "__range").withColumn("commit_index", F.col("__start") + F.col("__nth")).drop("__range", "__nth", "__start")


def at_commit(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, commit_index, content) of the version that holds at each wanted (path, commit_index); a file that isn't there has no row."""
    v = versions.select(F.col("path"), F.col("commit_index").alias("since"), "until", "content")
    return wanted.join(v, "path").where((F.col("since") <= F.col("commit_index")) & (F.col("commit_index") < F.col("until")) & F.col("content").isNotNull()).select("path", "commit_index", "content")
