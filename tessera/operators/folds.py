"""Accumulators: what is summed up over all records, or by key, and read at the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import looks_numeric, num


def fold(df: DataFrame, keys: list[str], **accumulators: Column) -> DataFrame:
    """One row for each key (or one row, without keys) with all accumulators, in one pass and one shuffle."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in accumulators.items()])


def folds(df: DataFrame, groups: dict[str, tuple[str, Column]]) -> DataFrame:
    """Several accumulators with keys of their own, in one pass: rows of ``name``, ``key`` (as text) and ``value``.

    A row is dealt to each of its keys and partially summed before the shuffle.
    """
    dealt = [F.struct(F.lit(n).alias("name"), F.col(k).cast("string").alias("key"), v.cast("double").alias("v")) for n, (k, v) in groups.items()]
    return df.select(F.explode(F.array(*dealt)).alias("x")).groupBy("x.name", "x.key").agg(F.sum("x.v").alias("value"))


def product(value: Column) -> Column:
    """Product of numbers, as doubles; nulls don't count."""
    return F.product(value.cast("double"))


def first_by(value: Column, order: Column | str) -> Column:
    """The value of the first row in order."""
    return F.min_by(value, order)


def last_by(value: Column, order: Column | str) -> Column:
    """The value that is assigned last in order."""
    return F.max_by(value, order)


def seen_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: partially reduced before the shuffle, so that a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(df.columns)


def distinct_values(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def joined_text(df: DataFrame, keys: list[str], value: str, order: str, separator: str = " ") -> DataFrame:
    """The values of each key as one text, in order. The result holds all of a key's text, as it must."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), separator).alias(value))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order; give a tie-break."""
    return df.orderBy(*order).limit(n)


def sorted_by(df: DataFrame, how: str, key: str = "key", value: str = "value") -> DataFrame:
    """Order key and value rows: ``ind`` or ``val``, ``str``, ``num`` or ``type``, ``asc`` or ``desc``, joined by ``_``; ties by key.

    ``type`` puts what looks like a number, by number, before texts.
    """
    what, kind, direction = how.removeprefix("@").split("_")
    own = F.col({"ind": key, "val": value}[what])
    columns = {"str": [own.cast("string")], "num": [num(own)], "type": by_type(own)}[kind]
    return df.orderBy(*[c.desc() if direction == "desc" else c.asc() for c in columns], key)


def by_type(value: Column) -> list[Column]:
    """Sort columns: what looks like a number first, by number, then other texts by code point."""
    shown = F.coalesce(value.cast("string"), F.lit(""))
    numeric = looks_numeric(shown)
    return [F.when(numeric, 0).otherwise(1), F.when(numeric, num(shown)).otherwise(0.0), shown]


def values_in_order(df: DataFrame, value: str = "value", ignore_case: bool = False) -> DataFrame:
    """The values numbered from 1 as ``i``: numbers before texts, as asort puts them. A value as often as it occurs.

    Distinct values are numbered over ranges, and their repeats after that, so that no task sorts all of them.
    """
    rank, number, shown = by_type(F.col(value))
    folded = F.lower(shown) if ignore_case else shown
    counts = df.groupBy(value).agg(F.count("*").cast("bigint").alias("_n")).withColumns({"_rank": rank, "_number": number, "_folded": folded, "_text": shown})
    parts = counts.repartitionByRange("_rank", "_number", "_folded", "_text").withColumn("_part", F.spark_partition_id())
    over = "over (partition by _part order by _rank, _number, _folded, _text rows between unbounded preceding and current row)"
    sized = parts.withColumn("_upto", F.expr(f"sum(_n) {over}"))
    totals = sized.groupBy("_part").agg(F.sum("_n").alias("_t"))
    before = totals.selectExpr("_part", "coalesce(sum(_t) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before")
    placed = sized.join(F.broadcast(before), "_part")
    at = F.sequence(F.col("_before") + F.col("_upto") - F.col("_n") + 1, F.col("_before") + F.col("_upto"))
    return placed.select(value, F.explode(at).alias("i"))


def sorted_with(df: DataFrame, comparator, columns: list[str], most: int = 10_000) -> DataFrame:
    """Rows of a small result in the order of a comparator, numbered from 1 as ``i``.

    The comparator takes two structs of the columns and gives a negative, zero or positive number. It needs all rows in
    one place, so that more than ``most`` are an error.
    """
    order = lambda a, b: F.sign(comparator(a, b)).cast("int")
    rows = df.limit(most + 1).agg(F.collect_list(F.struct(*columns)).alias("_all"))
    checked = F.when(F.size("_all") > most, F.raise_error(F.lit(f"a comparator sorts {most} rows at most")).cast(rows.schema["_all"].dataType))
    placed = rows.select(F.posexplode(F.array_sort(checked.otherwise(F.col("_all")), order)).alias("_i", "_r"))
    return placed.select((F.col("_i") + 1).cast("bigint").alias("i"), "_r.*")


def union_all(*parts: DataFrame) -> DataFrame:
    """Records of several inputs, with ``file_index`` for the order of the inputs."""
    return reduce(DataFrame.unionByName, [p.withColumn("file_index", F.lit(i)) for i, p in enumerate(parts)])
