"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sql, url_filter
from tessera.llm.ctw import ctw_scores
from tessera.llm.decontaminate import verdicts
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.licenses import BASE, TEMPLATES, license_scan
from tessera.llm.line_dedup import EXACT_CHARS, LENGTH_EDITS, line_dedup
from tessera.llm.packing import pack
from tessera.llm.quality import quality_scores
from tessera.llm.secrets import secret_report
from tessera.llm.simhash import simhash_dedup
from tessera.llm.url_filter import url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scores(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines, how many were dropped, and a digest of the text that is left."""
    out = line_dedup(_table(spark, sf_dir, "documents"), threshold=LENGTH_EDITS, exact_chars=EXACT_CHARS)
    left = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", "n_lines", "n_dropped", F.length(left).alias("chars_left"), F.sha2(left, 256).alias("text_sha256")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express: host, path and the rule that decides."""
    found = url_filter.url_rules(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"url_rules": url_rules}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": sql.SECRETS, "op5_licenses": sql.licenses(BASE, TEMPLATES), "op8_exact_dedup": sql.EXACT_DEDUP, "url_rules": sql.URL_RULES}
