"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, langid, licenses, linededup, minhash, mixing, quality, sitequality, tokencounts, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", cleaned["__lines_gone"].alias("lines_gone"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "source", "block_no", "slot", "nth", "phase")


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitequality.site_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"))


OP9_SQL = f"""
with docs as (
  select doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as w
  from documents where text is not null
), items as (
  select item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as w
  from benchmark where text is not null
), tests as (
  select distinct item_id, array_to_string(w[i : i + least({decontam.RUN}, len(w)) - 1], ' ') as run, least({decontam.RUN}, len(w)) as n
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - {decontam.RUN} + 1) + 1)) as i from items where w <> [''])
), sizes as (select distinct n from tests),
runs as (
  select distinct doc_id, n, array_to_string(w[i : i + n - 1], ' ') as run
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where w <> [''] and len(w) >= n)
)
select doc_id, item_id, cast(count(*) as integer) as runs from runs join tests using (n, run) group by doc_id, item_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_mix_sources": op6_mix_sources,
    "op7_site_quality": op7_site_quality,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op9_decontamination": OP9_SQL}
