"""Packing: length buckets by dynamic programming, and token-budget batches within each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of, written

#: Most hash groups of a bucket: bounds the table of running counts, which is broadcast.
GROUPS = 20_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges with the least padding in all.

    A document is padded to the bound of its range. ``lengths`` ascend. O(buckets * cells^2).
    """
    n = len(lengths)
    if not n:
        return []
    buckets = min(buckets, n)
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    cost = np.concatenate([[0.0], np.full(n, np.inf)])  # cost[j]: padded tokens of the first j lengths
    came = np.zeros((buckets, n + 1), np.int64)
    for b in range(buckets):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            whole = cost[:j] + lengths[j - 1] * (upto[j] - upto[:j])
            came[b, j] = i = int(whole.argmin())
            new[j] = whole[i]
        new[0] = 0.0
        cost = new
    bounds, j = [], n
    for b in range(buckets - 1, -1, -1):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(came[b, j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 8,
    budget: int = 16_384,
    rows_per_group: int = 5_000,
) -> DataFrame:
    """Place every document in a length bucket and in a batch of at most ``budget`` padded tokens.

    A document in a bucket whose bound is over ``budget`` has a batch to itself, which is marked ``over_budget``: texts
    are not cut here.

    A token is a run of non-space characters. The global histogram of lengths, summed on the
    executors, goes to the driver in geometric cells of at most 1/256 of the length (exact below
    512), so that its size doesn't grow with the corpus. Dynamic programming chooses the bounds of
    the ``buckets`` buckets with the least padding, to within what the cells pool: padding above the optimum's is at most
    1/256 of the tokens. A bucket of bound L makes batches of
    max(1, budget // L) documents, the last one maybe fewer.

    Places in a bucket are dealt in groups: documents are numbered within (bucket, hash group), groups
    of about ``rows_per_group`` rows, and a running count over the groups makes that a number within
    the bucket. No task holds a whole bucket.

    Null and empty texts have 0 tokens and go to the first bucket. Repeated rows are packed each. An
    empty table gives an empty result. Other columns are not read.

    Returns doc_id, n_tokens, bucket (from 0), bucket_tokens (its bound), batch (from 0 in each bucket),
    slot (from 0 in each batch), padding, over_budget.
    """
    spark = docs.sparkSession
    tokens = F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), tokens.alias("n_tokens")), "lengths")
    step = F.expr("cast(pow(2, greatest(floor(log2(greatest(n_tokens, 1))) - 8, 0)) as bigint)")
    cell = (F.ceil(F.col("n_tokens") / step) * step).cast("long")
    histogram = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.max("n_tokens").alias("most")).toPandas()
    histogram = histogram.sort_values("most")
    lengths, counts = histogram["most"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    bounds = best_bounds(lengths, counts, buckets) or [0]
    groups = max(1, min(GROUPS, int(counts.sum()) // rows_per_group))

    bound = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = rows.withColumn("bucket", F.size(F.filter(bound, lambda b: b < F.col("n_tokens")))).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(groups)).cast("int")
    )
    sizes = placed.groupBy("bucket", "group").agg(F.count("*").alias("n"))
    before = sizes.selectExpr(
        "bucket",
        "group",
        "sum(n) over (partition by bucket order by group rows between unbounded preceding and current row) - n as before",
    )
    limit = F.element_at(bound, F.col("bucket") + 1)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(limit, F.lit(1)))).cast("long")
    return (
        placed.withColumn("place", F.expr("row_number() over (partition by bucket, group order by n_tokens, doc_id) - 1"))
        .join(F.broadcast(before), ["bucket", "group"])
        .withColumn("place", F.col("place") + F.col("before"))
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            limit.alias("bucket_tokens"),
            F.floor(F.col("place") / per_batch).alias("batch"),
            (F.col("place") % per_batch).alias("slot"),
            (limit - F.col("n_tokens")).alias("padding"),
            (limit > budget).alias("over_budget"),
        )
    )
