"""From raw documents to a training mixture: five stages, each a written table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free_names, written
from palimpsest.llm.decontam import drop_contaminated
from palimpsest.llm.langid import drop_unidentified
from palimpsest.llm.linededup import dedup_lines
from palimpsest.llm.minhash import drop_near_duplicates
from palimpsest.llm.mixing import mixed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows.

    Null and empty texts go with the rest. Rows with null ids or languages and repeated rows are judged by their own
    texts. Where no text has a language, nothing but null and empty texts goes. Columns as they are, whatever their names.
    """
    return drop_unidentified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier documents hold; those of which nothing is left go.

    n_chars, where there is one, follows the text. Texts that were null or blank before stay, and so do rows without
    doc_id, unchanged. Repeated rows are cleaned alike. Columns as they are, whatever their names.
    """
    (gone,) = free_names(docs, "__lines_gone")
    cleaned = dedup_lines(docs, gone).where((F.col(gone) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; rows without doc_id come last.

    Rows that share a doc_id are judged by their own texts; of rows that agree in doc_id and text one stays. Null, empty
    and wordless texts are in no group. Columns as they are, whatever their names.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no run of words of a benchmark item, with or without an item_id.

    Each row is judged by its own text, whatever its id; null and wordless texts and all rows of an empty benchmark
    stay. Columns as they are, whatever their names.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources: block_no, slot, nth and phase.

    A null source is a source like others; rows with null ids or texts and repeated rows each have a place. Columns of
    docs by those four names are replaced.
    """
    return mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The first stage is a trained network, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table documents; what each returns is written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
