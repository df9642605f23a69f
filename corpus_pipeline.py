"""The training-data pipeline: documents to packed batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
to the shared folder and reads it back as the next stage's ``docs``. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, small, temporary, written
from tessera.llm.decontaminate import digest, text_contamination
from tessera.llm.line_dedup import EXACT_CHARS, LENGTH_EDITS, line_dedup
from tessera.llm.packing import pack
from tessera.llm.quality import quality_scores
from tessera.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null texts are scored as empty ones, and rows with a null id like others. Rows that repeat go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs.select("doc_id", "text", _row(docs)), labels, keep=("kept",))
    return scored.where("predicted = 1").select("kept.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines. One with nothing left but spaces is dropped, unless it had nothing to drop.

    ``n_chars``, where there is such a column, counts what is left. Null texts stay null; rows with a null id stay as they are, and rows
    that share an id are one document.
    """
    out = line_dedup(docs.select("doc_id", "text", _row(docs)), threshold=LENGTH_EDITS, exact_chars=EXACT_CHARS)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    kept = [F.when(F.col("n_dropped") > 0, new[c].cast(docs.schema[c].dataType)).otherwise(F.col("kept")[c]).alias(c) if c in new else F.col("kept")[c].alias(c) for c in docs.columns]
    return out.select(*kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id.

    Texts without words, null ones too, are one class. Rows with a null id stay, and rows that share an id are one document.
    """
    classes = simhash_dedup(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return _without(docs, classes)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. The text decides, so that ids may be null or repeat; null texts hold none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = text_contamination(docs, items).where("contaminated").select(F.col("digest").alias("_contaminated")).distinct()
    found = written(found, "removed")
    return docs.join(F.broadcast(found) if small(found) else found, digest("text") == F.col("_contaminated"), "left_anti").select(docs.columns)


def _row(docs: DataFrame) -> Column:
    """All columns of a document in one, so that none can clash with a column that an operator adds."""
    return F.struct(*docs.columns).alias("kept")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every row; null texts have no token."""
    return pack(docs)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = written(ids, "removed")
    return docs.join(F.broadcast(ids) if small(ids) else ids, "doc_id", "left_anti").select(docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("simhash", near_copies),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Trained scores and edit joins can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself is deleted when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            dropped(spark, before)
        before = docs
    return docs
