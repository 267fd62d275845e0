"""Plain and regular-expression search over a history, with or without the index: which versions match, where, and when first and last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import index
from palimpsest.plans import regex
from palimpsest.plans.regex import Need
from palimpsest.sources import history

#: Lines of a match shown before and after it; lines that a regex reports of a version.
BEFORE, AFTER, MOST_LINES = 2, 1, 11


@dataclass(frozen=True)
class Query:
    """A plain query has words, a regex query a Java pattern; alternatives are what the index can ask for.

    in_line: no match of the pattern is empty or depends on line ends, so texts are searched without cutting them into lines.
    """

    words: tuple[str, ...] = ()
    pattern: str = ""
    alternatives: tuple[tuple[Need, ...], ...] = ()
    in_line: bool = False

    @property
    def empty(self) -> bool:
        return not self.words and not self.pattern


def plain(query: str) -> Query:
    """All words, each anywhere in the file."""
    words = tuple(text.words_of(query))
    needs = [n for w in words for n in regex.needs((tuple(regex.escaped(c) for c in w),))]
    return Query(words=words, alternatives=(tuple(dict.fromkeys(needs)),) if words else ())


def pattern(query: str, strict: bool = False) -> Query:
    """A line that matches; strict rejects groups and anchors."""
    if not query:
        return Query()
    alternatives, java = regex.plan(query, strict)
    return Query(pattern=java, alternatives=tuple(map(tuple, alternatives)), in_line=all(alternatives) and regex.stays_in_line(regex.parse(query)[0]))


def _may_match(content: Column, query: Query) -> Column | None:
    """Whether a text holds all literal needs of some alternative: cheap tests in generated code before any pattern is tried."""
    out = None
    for a in query.alternatives:
        literal = [n.text for n in a if n.kind != "matches"]
        if not literal:
            return None
        held = F.contains(content, F.lit(literal[0]))
        for t in literal[1:]:
            held = held & F.contains(content, F.lit(t))
        out = held if out is None else out | held
    return out


def matches(content: Column, query: Query) -> Column:
    """Whether a text matches: for words one test each in place; for a regex literal tests first, then the pattern, line by line if line ends matter."""
    if query.empty:
        return F.lit(False)
    if query.pattern:
        found = content.rlike(query.pattern) if query.in_line else F.exists(text.lines(content), lambda line: line.rlike(query.pattern))
        may = _may_match(content, query)
        return found if may is None else may & found
    out = F.lit(True)
    for w in query.words:
        out = out & F.contains(content, F.lit(w))
    return out


def matching(changes: DataFrame, query: Query, postings: DataFrame | None = None, presence: DataFrame | None = None) -> DataFrame:
    """The versions (path, commit_index, content) that match: one scan, texts aren't shuffled.

    With postings or presence only candidates are verified; the rows are the same.
    """
    pruned = changes.where("content is not null")
    if not query.empty:
        if presence is not None and (found := index.candidate_versions(presence, changes, [list(a) for a in query.alternatives])) is not None:
            pruned = pruned.join(found, ["path", "commit_index"], "left_semi")
        elif postings is not None and (found := index.candidate_files(postings, [list(a) for a in query.alternatives])) is not None:
            pruned = pruned.join(found, "path", "left_semi")
    return pruned.where(matches(F.col("content"), query))


def _with_ends(seen: DataFrame, changes: DataFrame, head: DataFrame | None) -> DataFrame:
    """seen, which has path and newest (last matching commit of a change), with head and last: the head if the file is as it was at newest.

    Of the changes only path and commit are read, one row per file is shuffled.
    """
    ends = changes.groupBy("path").agg(F.max("commit_index").alias("__end"))
    both = seen.join(ends, "path").crossJoin(F.broadcast(history.head_of(changes) if head is None else head))
    return both.withColumn("last", F.when(F.col("newest") == F.col("__end"), F.col("head")).otherwise(F.col("newest"))).drop("__end")


def first_last(matched: DataFrame, changes: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """(path, first_commit, last_commit): the first and the last commit at which each file matches, out of those that changed it and the head.

    last_commit is null if there is no later one than the first. ``changes`` tells which files are
    live, ``head`` the last commit if that changed none of them.
    """
    seen = _with_ends(matched.groupBy("path").agg(F.min("commit_index").alias("first_commit"), F.max("commit_index").alias("newest")), changes, head)
    return seen.select("path", "first_commit", F.when(F.col("last") > F.col("first_commit"), F.col("last")).alias("last_commit"))


_PLACES = "array<struct<line_no:int,term:string,byte_column:int>>"


def _places(rows: Column, query: Query) -> Column:
    numbered = F.transform(rows, lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    if query.pattern:
        hits = F.slice(F.filter(numbered, lambda r: r["line"].rlike(query.pattern)), 1, MOST_LINES)
        return F.transform(hits, lambda r: F.struct(r["line_no"].alias("line_no"), F.regexp_extract(r["line"], query.pattern, 0).alias("term"), text.byte_column(r["line"], query.pattern).alias("byte_column")))

    def first(word: str) -> Column:
        held = F.filter(numbered, lambda r: F.contains(r["line"], F.lit(word)))
        return F.transform(F.slice(held, 1, 1), lambda r: F.struct(r["line_no"].alias("line_no"), F.lit(word).alias("term"), text.word_column(r["line"], word).alias("byte_column")))

    return F.array_sort(F.concat(*[first(w) for w in query.words])) if query.words else F.array().cast(_PLACES)


def places(content: Column, query: Query) -> Column:
    """Array of (line_no, term, byte_column): the first place of each word, or the first match in each of the first MOST_LINES matching lines."""
    return text.let(text.lines(content), lambda rows: _places(rows, query))


def context(line_numbers: Column, n_lines: Column) -> Column:
    """The numbers of the lines shown for some hits: BEFORE lines before to AFTER lines after each, within the file, sorted, each once."""
    around = F.transform(line_numbers, lambda n: F.sequence(F.greatest(n - BEFORE, F.lit(0)), F.least(n + AFTER, n_lines - 1)))
    return F.array_sort(F.array_distinct(F.flatten(around)))


def shown(content: Column, query: Query) -> Column:
    """Array of (line_number, content, highlights): the hits of a version with the lines around them; highlights are sorted by column."""

    def marks(found: Column, n: Column) -> Column:
        mine = F.array_sort(F.transform(F.filter(found, lambda p: p["line_no"] == n), lambda p: F.struct(p["byte_column"].alias("column"), p["term"].alias("term"))))
        return F.transform(mine, lambda m: F.struct(m["term"].alias("term"), m["column"].alias("column")))

    def around(rows: Column, found: Column) -> Column:
        numbers = context(F.array_distinct(F.transform(found, lambda p: p["line_no"])), F.size(rows))
        return F.transform(numbers, lambda n: F.struct(n.alias("line_number"), F.get(rows, n).alias("content"), marks(found, n).alias("highlights")))

    return text.let(text.lines(content), lambda rows: text.let(_places(rows, query), lambda found: around(rows, found)))


def hits(matched: DataFrame, query: Query, changes: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """(path, first_match, last_match): for each file the first and last matching commit with its lines; last_match is null if there is no later one.

    The lines are cut out before the one shuffle, so texts don't travel.
    """
    cut = matched.select("path", "commit_index", shown(F.col("content"), query).alias("lines"))
    best = cut.groupBy("path").agg(F.min("commit_index").alias("first"), F.min_by("lines", "commit_index").alias("first_lines"), F.max("commit_index").alias("newest"), F.max_by("lines", "commit_index").alias("last_lines"))
    detail = lambda c, lines: F.struct(F.col(c).alias("commit_index"), (F.col(c) == F.col("head")).alias("is_head"), F.col(lines).alias("lines"))
    return _with_ends(best, changes, head).select("path", detail("first", "first_lines").alias("first_match"), F.when(F.col("last") > F.col("first"), detail("last", "last_lines")).alias("last_match"))


def page(found: DataFrame, number: int, size: int, by: str = "path") -> DataFrame:
    """Page ``number`` of ``size`` rows in the order of ``by``; no rows if size is 0."""
    return found.orderBy(by).offset(number * size).limit(size) if size > 0 else found.limit(0)
