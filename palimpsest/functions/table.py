"""Table functions for SQL: trigrams(line) and search_text(text, query, mode)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from palimpsest.functions.text import literal_tokens, words_of


@udtf(returnType="position int, token string")
class Trigrams:
    """Each token of a line in order, with repeats; a line of one or two characters is its own token, an empty or null one has none."""

    def eval(self, line: str):
        yield from enumerate(literal_tokens(line) if line else [])


@udtf(returnType="line_no int, term string, char_column int, line string")
class SearchText:
    """The places of a query in a text: each word's first one in mode 'plain', if all words are there, or each matching line's first one in mode 'regex'."""

    def eval(self, text: str, query: str, mode: str):
        if not text or not query or not query.strip():
            return
        lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n")
        if mode == "regex":
            yield from ((n, m[0], m.start(), line) for n, line in enumerate(lines) if (m := re.search(query, line)))
        elif all(any(w in line for line in lines) for w in words_of(query)):
            yield from sorted(next((n, w, line.index(w), line) for n, line in enumerate(lines) if w in line) for w in words_of(query))


def register(spark: SparkSession) -> None:
    """Makes both known to SQL: select t.* from docs, lateral trigrams(docs.line) t."""
    spark.udtf.register("trigrams", Trigrams)
    spark.udtf.register("search_text", SearchText)
