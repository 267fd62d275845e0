"""Small tables with everything that may go wrong in them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, `key` int, gone string"
LONG = "wort " * 60_000 + "\n" + "x" * 300_000

EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, "n", 1, "g"),
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, "n", 1, "g"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 57, None, None, None),
    (3, None, "en", "a", None, "n", 1, "g"),
    (4, "", "en", None, 0, "n", 1, "g"),
    (5, " \n\t\n", None, None, None, "n", 1, "g"),
    (None, "a text without an id that is as long as others are here", "en", "b", 1, "n", 1, "g"),
    (None, None, None, None, None, None, None, None),
    (6, LONG, "de", "b", len(LONG), "n", 1, "g"),
    (7, "äöü ß 漢字 😀 \u0000 end", "de", "b", 18, "n", 1, "g"),
]


def docs(spark, rows=EDGES):
    return spark.createDataFrame(list(rows), DOCS)


def texts(spark, rows):
    """A documents table of (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, "en", "a", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
