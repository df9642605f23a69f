"""State that passes from record to record, without a window over one partition.

An order column is cut into ranges by approximate quantiles. Windows run within a range, and what one
range hands to the next is a row per range: a table as long as there are ranges, which is broadcast. The
range of a row depends on its order column alone, so that a task that is run again sees the same rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = "_range"


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: which of about ``ranges`` equal parts of the order column's values a row is in.

    ``ranges`` is three for each shuffle partition unless given. Nulls are in range 0. Bounds of a column of texts
    come from a sample of its values by hash. A row's range is found in two steps, each over as many bounds as
    the root of their number.
    """
    ranges = ranges or 3 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    if not steps:
        return df.withColumn(_RANGE, F.lit(0))
    kind = df.schema[order].dataType
    if not isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType | T.StringType):
        raise TypeError(f"no order by a column of {kind.simpleString()}")
    key = F.unix_micros(order) if isinstance(kind, T.TimestampType) else F.col(order)
    if isinstance(kind, T.StringType):
        bounds = _text_bounds(df, order, ranges)
    else:
        bounds = sorted(set(df.select(F.percentile_approx(key, steps, 10 * ranges)).first()[0] or []))
    if not bounds:
        return df.withColumn(_RANGE, F.lit(0))
    stride = max(1, math.isqrt(len(bounds)))
    coarse, fine = (F.array(*[F.lit(b) for b in part]) for part in (bounds[stride - 1 :: stride], bounds))
    below = F.coalesce(F.size(F.filter(coarse, lambda b: b < key)), F.lit(0)) * stride
    return df.withColumn(_RANGE, F.when(key.isNull(), 0).otherwise(below + F.size(F.filter(F.slice(fine, below + 1, stride), lambda b: b < key))))


def _text_bounds(df: DataFrame, order: str, ranges: int) -> list[str]:
    """About ``ranges`` - 1 values of a text column that part it evenly, from some 20 a range, chosen by their hash."""
    count, wanted = df.count(), 20 * ranges
    share = min(1.0, wanted / max(count, 1))
    chosen = df.where(F.pmod(F.xxhash64(order), F.lit(1 << 40)) < int(share * (1 << 40))).select(order).where(F.col(order).isNotNull())
    found = sorted({r[0] for r in chosen.limit(4 * wanted).collect()}, key=lambda t: t.encode())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}, key=lambda t: t.encode()) if found else []


def _carried(df: DataFrame, order: str, per_key: list[str], partial: dict[str, str], before: dict[str, str]) -> DataFrame:
    """Add columns of what all earlier ranges hand over: ``partial`` aggregates a range, ``before`` the earlier ranges' rows."""
    keys = ", ".join([*per_key, _RANGE])
    rows = df.groupBy(*per_key, _RANGE).agg(*[F.expr(x).alias(n) for n, x in partial.items()])
    over = f"over ({'partition by ' + ', '.join(per_key) if per_key else ''} order by {_RANGE} rows between unbounded preceding and 1 preceding)"
    sums = rows.selectExpr(*keys.split(", "), *[f"{x} {over} as {n}" for n, x in before.items()])
    if per_key:  # null is a key like any other
        sums = sums.withColumnsRenamed({k: f"_key_{k}" for k in [*per_key, _RANGE]})
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in [*per_key, _RANGE]])
        return df.join(sums, same).drop(*[f"_key_{k}" for k in [*per_key, _RANGE]])
    return df.join(F.broadcast(sums), _RANGE)


def _window(order: str, end: str = "current row") -> str:
    return f"over (partition by {_RANGE} order by {order} rows between unbounded preceding and {end})"


def numbered(df: DataFrame, order: str, name: str = "nr", ranges: int | None = None) -> DataFrame:
    """Add the number of a row in order, from 1. The order column's values must differ."""
    df = with_ranges(df, order, ranges)
    df = _carried(df, order, [], {"_n": "count(*)"}, {"_before": "sum(_n)"})
    number = F.expr(f"row_number() over (partition by {_RANGE} order by {order})") + F.coalesce("_before", F.lit(0))
    return df.withColumn(name, number.cast("bigint")).drop(_RANGE, "_before")


def running(df: DataFrame, order: str, name: str, value: str, how: str = "sum", ranges: int | None = None) -> DataFrame:
    """Add the running ``sum``, ``count``, ``min`` or ``max`` of an expression, the row itself included."""
    add = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}[how]
    df = with_ranges(df, order, ranges).withColumn("_v", F.expr(value))
    df = _carried(df, order, [], {"_p": f"{how}(_v)"}, {"_before": f"{add}(_p)"})
    own = F.expr(f"{how}(_v) {_window(order)}")
    both = {
        "sum": F.when(own.isNull(), F.col("_before")).otherwise(own + F.coalesce("_before", F.lit(0))),
        "count": own + F.coalesce("_before", F.lit(0)),
        "min": F.least(own, "_before"),
        "max": F.greatest(own, "_before"),
    }[how]
    return df.withColumn(name, both).drop(_RANGE, "_v", "_before")


def latched(
    df: DataFrame, order: str, name: str, value: str, when: str = "true", before: bool = False, ranges: int | None = None
) -> DataFrame:
    """Add the value that the last row for which ``when`` holds has set, the row itself included unless ``before``.

    Null if no row has set one. A null value that is set counts.
    """
    df = with_ranges(df, order, ranges).withColumn("_s", F.expr(f"case when {when} then struct({value} as v) end"))
    df = _carried(df, order, [], {"_l": f"max_by(_s, {order}) filter (where _s is not null)"}, {"_before": "last_value(_l) ignore nulls"})
    own = F.expr(f"last_value(_s) ignore nulls {_window(order, '1 preceding' if before else 'current row')}")
    return df.withColumn(name, F.coalesce(own, "_before")["v"]).drop(_RANGE, "_s", "_before")


def previous(df: DataFrame, order: str, name: str, value: str, ranges: int | None = None) -> DataFrame:
    """Add the value of the row before."""
    return latched(df, order, name, value, before=True, ranges=ranges)


def following(df: DataFrame, order: str, name: str, value: str, ranges: int | None = None) -> DataFrame:
    """Add the value of the row after: a look ahead by one."""
    df = with_ranges(df, order, ranges).withColumn("_s", F.expr(f"struct({value} as v)"))
    firsts = df.groupBy(_RANGE).agg(F.expr(f"min_by(_s, {order})").alias("_f"))
    firsts = firsts.select(_RANGE, F.expr(f"lead(_f) over (order by {_RANGE})").alias("_after"))
    own = F.expr(f"lead(_s) over (partition by {_RANGE} order by {order})")
    return df.join(F.broadcast(firsts), _RANGE).withColumn(name, F.coalesce(own, "_after")["v"]).drop(_RANGE, "_s", "_after")


def between(df: DataFrame, order: str, begin: str, end: str, ranges: int | None = None) -> DataFrame:
    """Rows from one where ``begin`` holds through the next where ``end`` holds, again and again.

    Both may hold for one row, which is then a span of its own.
    """
    df = df.withColumn("_b", F.coalesce(F.expr(begin), F.lit(False))).withColumn("_e", F.coalesce(F.expr(end), F.lit(False)))
    # a row that ends leaves the span closed; one that only begins leaves it open; others change nothing
    df = latched(df, order, "_open", "not _e", "_b or _e", before=True, ranges=ranges)
    return df.where("coalesce(_open, false) or _b").drop("_b", "_e", "_open")


def until(df: DataFrame, order: str, stop: str, per: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Rows up to the first for which ``stop`` holds, of all or of each group ``per``: exit, and next file."""
    cut = df.where(stop)
    if not per:  # one value, so that the filter can reach the scan
        found = cut.agg(F.min(order)).first()[0]
        return df if found is None else df.where(F.col(order) <= found if inclusive else F.col(order) < found)
    cuts = cut.groupBy(*per).agg(F.min(order).alias("_cut")).withColumnsRenamed({k: f"_key_{k}" for k in per})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in per])  # null is a group like any other
    out = df.join(cuts, same, "left").drop(*[f"_key_{k}" for k in per])
    before = F.col(order) <= F.col("_cut") if inclusive else F.col(order) < F.col("_cut")
    return out.where(F.col("_cut").isNull() | before).drop("_cut")


def sampled(df: DataFrame, order: str, every: int, offset: int = 0, ranges: int | None = None) -> DataFrame:
    """Every ``every``-th row in order."""
    return numbered(df, order, "_nr", ranges).where(F.col("_nr") % every == offset).drop("_nr")


def ranked_within(df: DataFrame, keys: list[str], order: str, name: str = "n") -> DataFrame:
    """Add how many rows of the same key there are up to this one. Ranges keep a hot key out of one task."""
    df = with_ranges(df, order)
    df = _carried(df, order, keys, {"_n": "count(*)"}, {"_before": "sum(_n)"})
    own = F.expr(f"row_number() over (partition by {', '.join(keys)}, {_RANGE} order by {order})")
    return df.withColumn(name, (own + F.coalesce("_before", F.lit(0))).cast("bigint")).drop(_RANGE, "_before")


def sessions(df: DataFrame, keys: list[str], order: str, gap: float, name: str = "session", ranges: int | None = None) -> DataFrame:
    """Add the number of a row's session within its key, from 1: a new one begins after more than ``gap``.

    Ranges keep a hot key out of one task: the last row of a key, and its sessions so far, pass from range to range.
    """
    over = f"over (partition by {', '.join([*keys, _RANGE])} order by {order})"
    df = _carried(with_ranges(df, order, ranges), order, keys, {"_m": f"max({order})"}, {"_last": "max(_m)"})
    before = F.coalesce(F.expr(f"lag({order}) {over}"), "_last")
    df = df.withColumn("_o", F.when(F.col(order) - before <= gap, 0).otherwise(1)).drop("_last")
    df = _carried(df, order, keys, {"_n": "sum(_o)"}, {"_before": "sum(_n)"})
    total = F.expr(f"sum(_o) {over}") + F.coalesce("_before", F.lit(0))
    return df.withColumn(name, total).drop(_RANGE, "_o", "_before")


def as_of(df: DataFrame, table: DataFrame, keys: list[str], order: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """Add the ``values`` of the table's last row of the same key whose ``order`` is at most the row's own, or nulls.

    Both sides go through one ordered pass, so that nothing is joined pair by pair. Of table rows with the
    same key and order the one with the largest values counts. Null is a key like any other.
    """
    latest = table.groupBy(*keys, order).agg(F.max(F.struct(*values)).alias("_t"))
    both = df.withColumn("_own", F.lit(1)).unionByName(latest.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    partial = {"_p": f"max_by(_t, {order}) filter (where _own = 0)"}
    both = _carried(with_ranges(both, order, ranges), order, keys, partial, {"_before": "last_value(_p) ignore nulls"})
    over = f"over (partition by {', '.join([*keys, _RANGE])} order by {order}, _own rows between unbounded preceding and current row)"
    found = both.withColumn("_f", F.coalesce(F.expr(f"last_value(_t) ignore nulls {over}"), "_before")).where("_own = 1")
    return found.select(*df.columns, *[F.col(f"_f.{v}").alias(v) for v in values])
