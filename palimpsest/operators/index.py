"""The token index of a history: dictionary, postings, presence intervals and what they prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text, windows
from palimpsest.plans.regex import Need


def version_tokens(changes: DataFrame) -> DataFrame:
    """(path, commit_index, token): the distinct tokens of every version, distinct before anything is shuffled."""
    return changes.where("content is not null").select("path", F.col("commit_index").cast("long"), "content").mapInArrow(windows.each, windows.EACH)


def postings(changes: DataFrame) -> DataFrame:
    """(token, path): files that ever held a token. Deletions take nothing away.

    Versions of a file are tokenised together in Arrow batches. What is shuffled are arrays of numbers, a few
    rows for each file and task; only the distinct pairs become strings and rows.
    """
    packed = changes.where("content is not null").select("path", "content").mapInArrow(windows.packed, windows.PACKED)
    return packed.repartition("path", "part").sortWithinPartitions("path", "part").mapInArrow(windows.unpacked, windows.PAIRS)


def dictionary(postings: DataFrame) -> DataFrame:
    """(token): every token of the index once."""
    return postings.select("token").distinct()


def token_lines(changes: DataFrame) -> DataFrame:
    """(path, commit_index, token, line_numbers): in which lines, counted from 0, a version has a token; sorted, each once."""
    rows = changes.where("content is not null").select("path", "commit_index", F.posexplode(text.lines("content")).alias("line_no", "line"))
    each = rows.select("path", "commit_index", "line_no", F.explode(F.array_distinct(text.line_tokens("line"))).alias("token"))
    return each.groupBy("path", "commit_index", "token").agg(F.array_sort(F.collect_set("line_no")).alias("line_numbers"))


def token_stats(changes: DataFrame) -> DataFrame:
    """(token, n_lines, n_files): in how many lines of all versions, and in how many files, each token is; counts are added up before they are shuffled."""
    rows = changes.where("content is not null").select("path", F.explode(text.lines("content")).alias("line"))
    each = rows.select("path", F.explode(F.array_distinct(text.line_tokens("line"))).alias("token"))
    per_file = each.groupBy("token", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("token").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_files"))


def presence(versions: DataFrame) -> DataFrame:
    """(path, token, from_commit, to_commit): maximal intervals of commits, the end excluded, in which a file has a token.

    Runs of versions without a gap are one interval. Everything is partitioned by (path, token)
    after one window by path over the versions themselves, which are far fewer.
    """
    nth = versions.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("commit_index")))
    held = nth.where("content is not null").select("path", "nth", "commit_index", "until", F.explode(text.tokens("content")).alias("token"))
    run = F.col("nth") - F.row_number().over(Window.partitionBy("path", "token").orderBy("nth"))
    return held.withColumn("run", run).groupBy("path", "token", "run").agg(F.min("commit_index").alias("from_commit"), F.max("until").alias("to_commit")).drop("run")


def modified_or_head(versions: DataFrame) -> DataFrame:
    """(path, commit_index, since): the commits at which a file is looked at: those that changed it, and the head if the file is live.

    since is the commit of the version that holds there; deletions give none.
    """
    live = versions.where("content is not null")
    changed = live.select("path", "commit_index", F.col("commit_index").alias("since"))
    return changed.unionByName(live.where("until > head and commit_index < head").select("path", F.col("head").alias("commit_index"), F.col("commit_index").alias("since")))


def _holds(token: Column, need: Need) -> Column:
    return token == need.text if need.kind == "is" else token.contains(need.text) if need.kind == "holds" else token.rlike(need.text)


def with_needs(rows: DataFrame, needs: list[Need]) -> DataFrame:
    """Rows with a column token, and the numbers of the needs that the token meets as an array ``met``; others are left out.

    The condition is on the token alone, so exact needs reach a stored table's scan as a list of values.
    """
    exact = [n.text for n in needs if n.kind == "is"]
    loose = [n for n in needs if n.kind != "is"]
    where = F.col("token").isin(exact) if exact else F.lit(False)
    for n in loose:
        where = where | _holds(F.col("token"), n)
    met = F.array_compact(F.array(*[F.when(_holds(F.col("token"), n), F.lit(i)) for i, n in enumerate(needs)]))
    return rows.where(where).withColumn("met", met)


def _any_met(alternatives: list[list[Need]], needs: list[Need], met: Column) -> Column:
    at = {n: i for i, n in enumerate(needs)}
    out = F.lit(False)
    for a in alternatives:
        out = out | (F.size(F.array_except(F.array(*[F.lit(at[n]) for n in a]), met)) == 0)
    return out


def candidate_files(postings: DataFrame, alternatives: list[list[Need]]) -> DataFrame | None:
    """(path): files that ever had tokens for all needs of some alternative; None if nothing can be pruned, no rows for no alternative.

    One pass over the postings of the needed tokens and one shuffle by path, however many alternatives.
    """
    if any(not a for a in alternatives):
        return None
    needs = list(dict.fromkeys(n for a in alternatives for n in a))
    if not needs:
        return postings.select("path").where(F.lit(False))
    met = with_needs(postings, needs).groupBy("path").agg(F.array_distinct(F.flatten(F.collect_set("met"))).alias("met"))
    return met.where(_any_met(alternatives, needs, F.col("met"))).select("path")


def candidate_versions(presence: DataFrame, changes: DataFrame, alternatives: list[list[Need]]) -> DataFrame | None:
    """(path, commit_index): versions at which tokens for all needs of some alternative are present; None if nothing can be pruned.

    Presence intervals meet versions by path and range, both of one file only.
    """
    if any(not a for a in alternatives):
        return None
    needs = list(dict.fromkeys(n for a in alternatives for n in a))
    ids = changes.where("content is not null").select("path", "commit_index")
    if not needs:
        return ids.where(F.lit(False))
    held = with_needs(presence, needs).select("path", "from_commit", "to_commit", "met")
    there = held.join(ids, "path").where((F.col("from_commit") <= F.col("commit_index")) & (F.col("commit_index") < F.col("to_commit")))
    met = there.groupBy("path", "commit_index").agg(F.array_distinct(F.flatten(F.collect_set("met"))).alias("met"))
    return met.where(_any_met(alternatives, needs, F.col("met"))).select("path", "commit_index")
