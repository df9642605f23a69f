"""Rules and accumulators over streams. What has no end has no final result: accumulators give updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.folds import fold
from tessera.operators.rules import Rule, apply_rules


def stream_lines(df: DataFrame, rules: list[Rule], keep: list[str], name: str = "out") -> DataFrame:
    """Rules without state run on a stream as they do on a table."""
    return apply_rules(df, rules, keep, name)


def stream_fold(df: DataFrame, keys: list[str], **accumulators: Column) -> DataFrame:
    """Accumulators by key, for the output modes ``update`` and ``complete``. State grows with the keys."""
    return fold(df, keys, **accumulators)


def stream_windows(df: DataFrame, time: str, size: str, late: str, keys: list[str], **accumulators: Column) -> DataFrame:
    """Accumulators by key and time window; a window is closed ``late`` after its end, and its state dropped."""
    found = fold(df.withWatermark(time, late).withColumn("_w", F.window(time, size)), ["_w", *keys], **accumulators)
    return found.select(F.col("_w.start").alias("start"), *keys, *accumulators)


def stream_seen_first(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten ``late`` after their time."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def stream_running(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """State that passes from record to record of a key: ``n`` (number), ``total`` (running sum) and ``before`` (the value before).

    Records of a key that come together are taken by ``order``; what came earlier stays first. A null value adds
    nothing. State is a row a key.
    """
    fields = [df.schema[k] for k in keys] + [df.schema[order], T.StructField(value, T.DoubleType())]
    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("before", T.DoubleType())])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, before = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        found = rows[value].astype("float64")
        rows = rows.assign(**{
            "n": range(n + 1, n + len(rows) + 1), "total": total + found.fillna(0.0).cumsum(), "before": found.shift(1, fill_value=float("nan") if before is None else before),
        })
        last = found.iloc[-1]
        state.update((n + len(rows), float(rows["total"].iloc[-1]), None if pd.isna(last) else float(last)))
        yield rows[out.names]

    grouped = df.select(*keys, order, F.col(value).cast("double").alias(value)).groupBy(*keys)
    return grouped.applyInPandasWithState(step, out, "n bigint, total double, before double", "append", GroupStateTimeout.NoTimeout)
