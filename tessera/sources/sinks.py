"""Text output: print, and redirection by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import text
from tessera.plans import ordered
from tessera.sources.records import escaped


def printed(df: DataFrame, values: list[str], separator: str = " ", alias: str = "line") -> Column:
    """What print makes of columns: numbers as text, null empty, joined by the separator."""
    kinds = dict(df.dtypes)

    def shown(name: str) -> Column:
        kind = kinds[name]
        if kind in ("double", "float") or kind.startswith("decimal"):
            return text(F.col(name))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return F.concat_ws(separator, *map(shown, values)).alias(alias)


def write_lines(df: DataFrame, line: str, path: str, end: str = "\n", append: bool = False) -> None:
    """Write a column as text files, one line a row."""
    df.select(line).write.mode("append" if append else "overwrite").option("lineSep", end).text(path)


def redirect(df: DataFrame, line: str, target: str, path: str, salts: int = 1) -> None:
    """Write lines to one folder for each value of ``target``.

    Rows are dealt by target and a salt, so that a target is written by at most ``salts`` tasks and a
    hot one by no fewer than it has rows for.
    """
    salted = df.select(line, target, F.pmod(F.xxhash64(line), F.lit(salts)).alias("_salt"))
    dealt = salted.repartition(target, "_salt") if salts > 1 else salted
    dealt.drop("_salt").write.mode("overwrite").partitionBy(target).text(path)


def write_table(df: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """Write keys and values as lines with a tab between; tabs and newlines in them are escaped. Null is empty."""
    shown = [escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (key, value)]
    write_lines(df.select(F.concat_ws("\t", *shown).alias("line")), "line", path)


def fragments(df: DataFrame, order: str, piece: str) -> DataFrame:
    """Lines that are put out in pieces, as by printf without a newline: ``line_no``, from 0, and ``line``.

    A piece belongs to the line that the newlines before it have reached; one that holds newlines belongs to
    several. A last line without an end counts if it isn't empty. The order column's values must differ.
    """
    own = F.coalesce(F.col(piece).cast("string"), F.lit(""))
    cut = df.select(F.col(order), F.split(own, "\n", -1).alias("_parts")).withColumn("_ends", F.size("_parts") - 1)
    placed = ordered.running(cut, order, "_upto", "_ends")
    parts = placed.select(order, "_ends", (F.col("_upto") - F.col("_ends")).alias("_before"), F.posexplode("_parts").alias("_i", "_part"))
    parts = parts.withColumn("_ended", F.col("_i") < F.col("_ends"))
    lines = parts.groupBy((F.col("_before") + F.col("_i")).alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "_i", "_part"))).alias("_all"), F.max("_ended").alias("_ended")
    )
    line = F.array_join(F.transform("_all", lambda x: x["_part"]), "").alias("line")
    return lines.select("line_no", line, "_ended").where("_ended or line <> ''").drop("_ended")
