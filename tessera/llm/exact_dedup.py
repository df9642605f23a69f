"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, text_of, written


def normalised(text: Column) -> Column:
    """The text without any space, tab, line or page break."""
    for char in SPACES:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1000) -> DataFrame:
    """Group documents whose texts are equal when whitespace is deleted, and pick the one that stays.

    1. One pass reduces each document to id, length and SHA-256 of its normalised text.
    2. A Misra-Gries summary (``freqItems``, at most ``counters`` counters a task and in all) finds
       every digest held by more than 1/``counters`` of all rows, and perhaps some others.
    3. Those candidates, at most ``counters`` of them, are counted exactly. The ones that really
       are frequent are broadcast with their winner, so that the rows of a hot digest are
       resolved where they lie and never meet in one task.
    4. All other rows are shuffled by digest; no group there holds over 1/``counters`` of the rows.

    The row with the most code points in its original text stays, then the smallest id.
    Null text counts as empty; empty and blank texts are equal to each other. A null id comes after
    all others. Rows repeated with the same id and text are both counted and both marked alike.
    An empty table gives an empty result. Other columns are not read, whatever their names.

    Returns doc_id, keep_id, group_size, kept, text_sha256: a row for every input row.
    """
    text = text_of(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.length(text).cast("long").alias("n_chars"),
        ),
        "digests",
    )
    total = rows.count()
    candidates = (
        rows.select(F.hex("digest").alias("d"))
        .stat.freqItems(["d"], support=1 / counters)
        .select(F.explode("d_freqItems").alias("d"))
        .select(F.unhex("d").alias("digest"))
    )
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id"))["doc_id"]
    winners = (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") * counters > total)
    )
    winners = written(winners, "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    groups = "over (partition by digest)"
    cold = rows.join(F.broadcast(winners), "digest", "left_anti").select(
        "*",
        F.expr(f"min(struct(-n_chars as n, doc_id is null as no_id, doc_id)) {groups}.doc_id").alias("keep_id"),
        F.expr(f"count(*) {groups}").alias("group_size"),
    )
    return hot.unionByName(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
