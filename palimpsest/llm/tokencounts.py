"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer questions about every context limit."""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Where the ranks of a public byte-level vocabulary are, and the pattern that cuts texts before its merges.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[tuple[int, str], object] = {}


def encoding(ranks: bytes, pattern: str = PATTERN):
    """The encoder for the bytes of a rank file; each process builds it once."""
    import tiktoken

    key = (hash(ranks), pattern)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def lengths(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to so many tokens; a null or empty text has 0.

    Texts are encoded whole, as ordinary text. Each batch is counted where it is encoded, so only counts are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def count(batches):
        encode = encoding(shared.value, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(0)]
            values, counts = np.unique(np.array(n, np.int64), return_counts=True)
            yield pa.record_batch([pa.array(values), pa.array(counts.astype(np.int64))], names=["n_tokens", "n_docs"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length that occurs, exact counts and sums over the documents with fewer, as many and more tokens.

    n_docs of this length; docs_up_to and tokens_up_to with at most, docs_beyond with more tokens;
    truncated_total, the tokens that are left if every document is cut to this length; quantile,
    the share of documents up to it. The lengths are as many as the longest document has tokens at
    most, whatever the corpus; still the sums are taken within blocks of 1024 lengths and over the
    blocks, so no task gets all lengths.
    """
    blocks = hist.withColumn("block", F.floor(F.col("n_tokens") / 1024))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    sums = sums.select("block", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.sum("d").over(whole).alias("docs"))
    here = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = (
        blocks.join(sums, "block")
        .withColumn("docs_up_to", F.col("d0") + F.sum("n_docs").over(here))
        .withColumn("tokens_up_to", F.col("t0") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(here))
        .withColumn("docs_beyond", F.col("docs") - F.col("docs_up_to"))
    )
    return up.select(
        "n_tokens", "n_docs", "docs_up_to", "tokens_up_to", "docs_beyond",
        (F.col("tokens_up_to") + F.col("n_tokens") * F.col("docs_beyond")).alias("truncated_total"),
        (F.col("docs_up_to") / F.col("docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """suffix_sums() of the encoded lengths of all documents.

    Null and empty texts count with 0 tokens, repeated rows each count, an empty table gives no
    rows, ties share a row. Only text is read, so other columns may have any name and nulls. The
    histogram is written once, as the sums read it twice and texts are encoded once.
    """
    return suffix_sums(written(lengths(docs, ranks_path, pattern), "lengths"))


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, truncated_total, docs_cut): tokens left and documents cut if documents are cut at each limit of a column context_limit.

    A limit that is no length of a document is reached from the next lower length: the documents beyond have all tokens up to the limit.
    """
    joined = limits.select("context_limit").where("context_limit is not null").distinct().join(sums, F.col("n_tokens") <= F.col("context_limit"), "left")
    low = joined.groupBy("context_limit").agg(F.max_by(F.struct("n_tokens", "truncated_total", "docs_beyond"), "n_tokens").alias("x"))
    docs = sums.agg(F.sum("n_docs").alias("docs"))
    beyond = F.coalesce("x.docs_beyond", "docs")
    return low.crossJoin(F.broadcast(docs)).select(
        "context_limit",
        (F.coalesce("x.truncated_total", F.lit(0)) + (F.col("context_limit") - F.coalesce("x.n_tokens", F.lit(0))) * beyond).alias("truncated_total"),
        beyond.alias("docs_cut"),
    )
