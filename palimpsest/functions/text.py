"""Column expressions over texts, lines and tokens; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A segment of this many bytes is shortened to so many characters at either end.
LONG_BYTES, KEPT_CHARS = 80, 40
RED, RESET, GAP = "\x1b[31m", "\x1b[0m", "..."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(word: str) -> str:
    """A Java pattern for exactly this text."""
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-&~#" else c for c in word)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that is used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def lines(content: Column | str) -> Column:
    """The lines of a text without their line ends; a last empty line is none. Null gives null, '' no lines."""
    c = F.replace(_col(content), F.lit("\r\n"), F.lit("\n"))
    c = F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    return F.when(_col(content) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1))


def line_tokens(line: Column | str) -> Column:
    """Windows of three characters of a line in their order; the line itself if it has one or two, nothing if none.

    One pass of a lookahead yields all windows; cutting them out one by one would take time in the
    square of the line's length.
    """
    line = _col(line)
    short = F.when(line == "", F.array().cast("array<string>")).otherwise(F.array(line))
    return F.when(F.length(line) < 3, short).otherwise(F.regexp_extract_all(line, F.lit(r"(?s)(?=(...))."), F.lit(1)))


def tokens(content: Column | str) -> Column:
    """The distinct tokens of all lines of a text, in two passes over it and without an array of its lines."""
    c = F.replace(_col(content), F.lit("\r\n"), F.lit("\n"))
    windows = F.regexp_extract_all(c, F.lit(r"(?=([^\n]{3}))[^\n]"), F.lit(1))
    short = F.regexp_extract_all(c, F.lit(r"(?:(?<=\n)|\A)([^\n]{1,2})(?=\n|\z)"), F.lit(1))
    return F.array_distinct(F.concat(windows, short))


def byte_column(line: Column, pattern: str) -> Column:
    """Bytes before the first match of a Java pattern in a line that has one."""
    return F.octet_length(F.regexp_extract(line, f"(?s)^(.*?)(?:{pattern})", 1))


def word_column(line: Column, word: str) -> Column:
    """Bytes before the first occurrence of a word in a line that holds it."""
    return F.octet_length(F.substring_index(line, word, 1))


def leftmost_first(words: list[str]) -> str:
    """A Java pattern that finds several words as one scan does: the leftmost match, of those the word named first."""
    return "|".join(quoted(w) for w in words)


def found_words(content: Column | str, words: list[str]) -> Column:
    """The words that one leftmost-first scan without overlaps finds: a word may be hidden by one named before it."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(content), F.lit(leftmost_first(words)), F.lit(0))))


def shortened(segment: Column | str) -> Column:
    """Segments of LONG_BYTES or more as their first and last KEPT_CHARS characters with ' ... ' between."""
    s = _col(segment)
    return F.when(F.octet_length(s) < LONG_BYTES, s).otherwise(F.concat(F.substring(s, 1, KEPT_CHARS), F.lit(f" {GAP} "), F.right(s, F.lit(KEPT_CHARS))))


def highlighted(line: Column | str, words: list[str], before: str = RED, after: str = RESET) -> Column:
    """The line with the first occurrence of each word between two marks (words that overlap an earlier one stay plain)."""
    return F.regexp_replace(_col(line), f"({leftmost_first(words)})", before.replace("\\", "\\\\").replace("$", "\\$") + "$1" + after.replace("\\", "\\\\").replace("$", "\\$"))


def marked(line: str, places: list[tuple[str, int]], before: str = RED, after: str = RESET, shorten: bool = False) -> str:
    """A line with terms marked at their byte columns; with shorten, what lies between is shortened."""
    raw, at, out = line.encode(), 0, []
    cut = short if shorten else (lambda s: s)
    for term, column in sorted(places, key=lambda p: p[1]):
        if column < at:
            continue
        end = column + len(term.encode())
        out += [cut(raw[at:column].decode(errors="replace")), before, term, after]
        at = end
    return "".join([*out, cut(raw[at:].decode(errors="replace"))])


def short(segment: str) -> str:
    """shortened() for one string."""
    if len(segment.encode()) < LONG_BYTES:
        return segment
    return f"{segment[:KEPT_CHARS]} {GAP} {segment[-KEPT_CHARS:]}"


def numbered(n: Column | str) -> Column:
    """A line number, right-aligned to six places, and a bar; longer numbers are not cut."""
    n = _col(n).cast("string")
    return F.concat(F.when(F.length(n) < 6, F.lpad(n, 6, " ")).otherwise(n), F.lit("| "))


def commit_label(commit_id: Column, time: Column, is_head: Column) -> Column:
    """'HEAD (at 2024-01-31 12:00)' for the head, else the first eight digits of the commit and its time."""
    return F.concat(F.when(is_head, F.lit("HEAD")).otherwise(F.substring(commit_id, 1, 8)), F.lit(" (at "), F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit(")"))


def seen_text(first: Column, last: Column) -> Column:
    """'First seen at …, last seen at …' or '…, never seen afterwards'."""
    return F.concat(F.lit("First seen at "), first, F.coalesce(F.concat(F.lit(", last seen at "), last), F.lit(", never seen afterwards")))


def query_of(text: str) -> tuple[str, str]:
    """(mode, query) of an input line: 'q:' is plain, 'r:' and no prefix regex."""
    m = re.match(r"\s*([qr]):(.*)\Z", text, re.S)
    return ("plain" if m[1] == "q" else "regex", m[2].strip()) if m else ("regex", text.strip())


def words_of(query: str) -> list[str]:
    """The words of a plain query, each once, in order."""
    return list(dict.fromkeys(query.split()))


def literal_tokens(text: str) -> list[str]:
    """The tokens of a literal in order and with repeats; a literal of one or two characters is its own token."""
    if len(text) < 3:
        return [text] if text else []
    return [text[i : i + 3] for i in range(len(text) - 2)]
