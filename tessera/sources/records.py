"""Records from text files, and fields of a record."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.regex import java


def read_records(spark: SparkSession, paths: str | list[str], separator: str = "\n") -> DataFrame:
    """Records of text files: ``record``, ``filename`` and ``pos``, which ascends within a file.

    A separator of one character splits files between tasks; ``pos`` is then unique and ascending for one
    read but has gaps. An empty separator means paragraphs, set apart by blank lines, and a longer one
    is a pattern; both read each file whole, because a match can stand anywhere, and ``pos`` counts from 0.
    """
    file = F.col("_metadata.file_path")
    if len(separator) == 1:
        lines = spark.read.text(paths, lineSep=separator)
        at = F.monotonically_increasing_id()
        return lines.select(F.col("value").alias("record"), file.alias("filename"), at.alias("pos"))
    whole = spark.read.text(paths, wholetext=True).select("value", file.alias("filename"))
    return split_records(whole, separator)


def split_records(whole: DataFrame, separator: str, column: str = "value") -> DataFrame:
    """Split a column of whole texts into records by a pattern, or into paragraphs where it is empty.

    Adds ``record``, ``pos``, from 0, and ``rt``, the text that ended the record, and drops the column. The last record may
    lack its separator; its ``rt`` is empty then. Empty and null texts have no record.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    if separator:
        pattern = java(separator) if len(separator) > 1 else re.escape(separator)
        cut = F.struct(text.alias("text"), F.lit("").alias("tail"))
    else:  # possessive, so that the pattern's matcher doesn't call itself for each blank line
        pattern = r"\n(?:[ \t]*\n)++"
        text = F.regexp_replace(text, r"\A(?:[ \t]*\n)++", "")
        cut = F.struct(F.rtrim(text, F.lit(" \t\n")).alias("begin"), text.alias("text"))
        # blanks in the line of the last word belong to the record
        cut = _let(cut, lambda c: F.struct(c["begin"].alias("begin"), F.substring(c["text"], F.length(c["begin"]) + 1, F.length(c["text"])).alias("tail")))
        cut = _let(cut, lambda c: F.struct(c["begin"].alias("begin"), F.substring_index(c["tail"], "\n", 1).alias("blank"), c["tail"].alias("tail")))
        cut = _let(
            cut,
            lambda c: F.struct(
                F.concat(c["begin"], c["blank"]).alias("text"), F.substring(c["tail"], F.length(c["blank"]) + 1, F.length(c["tail"])).alias("tail")
            ),
        )
    found = whole.withColumn("_cut", cut)
    parts, ends = F.split("_cut.text", pattern, -1), F.regexp_extract_all("_cut.text", F.lit(pattern), F.lit(0))
    parts = _let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    both = F.arrays_zip(parts.alias("record"), F.concat(ends, F.array("_cut.tail")).alias("rt"))
    both = F.filter(both, lambda x: x["record"].isNotNull())
    return found.select(*whole.columns, F.posexplode(both).alias("pos", "_r")).select(*whole.columns, "pos", "_r.record", "_r.rt").drop(column)


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fields(record: Column, separator: str = " ", paragraph: bool = False) -> Column:
    """Array of the fields of a record; an empty record has none.

    A blank separator: runs of blanks, also at the ends, are ignored. One character: literal, and in
    paragraphs a newline separates too. Empty: characters. Longer: a pattern.
    """
    if separator == " ":
        record = F.regexp_replace(record, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
        pattern = r"[ \t\n\r\f]+"
    elif len(separator) == 1:
        pattern = re.escape(separator) + (r"|\n" if paragraph else "")
    else:
        pattern = java(separator) if separator else ""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(record, F.lit("")) == "", none).otherwise(F.split(record, pattern, -1))


def fields_by_content(record: Column, pattern: str) -> Column:
    """Array of what matches the pattern."""
    return F.regexp_extract_all(F.coalesce(record, F.lit("")), F.lit(java(pattern)), F.lit(0))


def fields_by_width(record: Column, widths: str) -> Column:
    """Array of fields of fixed width: ``5 2:3 *`` is 5 characters, 3 after skipping 2, and the rest."""
    at, out = 1, []
    for width in widths.split():
        skip, _, size = width.rpartition(":")
        at += int(skip or 0)
        piece = F.substring(record, at, 2**31 - 1 if size == "*" else int(size))
        out.append(F.when(F.length(record) >= at, piece))
        at += 0 if size == "*" else int(size)
    return F.array_compact(F.array(*out))


def csv_fields(record: Column) -> Column:
    """Array of the fields of a CSV line: quotes may stand around a field, doubled ones inside it."""
    whole = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',(?:"[^"]*+(?:""[^"]*+)*+"|[^,]*)'), F.lit(0))
    bare = F.transform(whole, lambda x: F.substring(x, F.lit(2), F.length(x)))
    plain = F.transform(
        bare, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    )
    return F.when(F.coalesce(record, F.lit("")) == "", F.array().cast("array<string>")).otherwise(plain)


def field(parts: Column, number: int) -> Column:
    """A field by number, from 1; empty past the end. A negative number counts from the last, -1."""
    return F.coalesce(F.try_element_at(parts, F.lit(number)), F.lit(""))


def with_field(parts: Column, number: int, value: Column) -> Column:
    """The fields with one set; fields between the old end and the new one are empty."""
    size = F.greatest(F.size(parts), F.lit(number))
    return F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.when(i == number, value).otherwise(F.coalesce(F.try_element_at(parts, i), F.lit(""))),
    )


def updated_field(parts: Column, number: int, change) -> Column:
    """The fields with one changed: ``change`` takes its text, as for ``+=`` and ``++``."""
    return with_field(parts, number, change(field(parts, number)))


def with_count(parts: Column, count: int) -> Column:
    """The fields cut or extended to ``count``."""
    if count == 0:
        return F.array().cast("array<string>")
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.coalesce(F.try_element_at(parts, i), F.lit("")))


def joined(parts: Column, separator: str = " ") -> Column:
    """The record rebuilt from its fields."""
    return F.array_join(parts, separator)


def record_of(df: DataFrame, columns: list[str], separator: str = " ") -> Column:
    """A record made of typed columns; null is empty."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def stream_records(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """Records of files that come to a folder, as a stream: ``record`` and ``filename``. The separator has one character."""
    if len(separator) != 1:
        raise ValueError("a stream's separator has one character")
    lines = spark.readStream.format("text").option("lineSep", separator).load(path)
    return lines.select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("filename"))


def file_edges(df: DataFrame, file: str, order: str, begin: Column, end: Column) -> DataFrame:
    """What is put out before and after each file's records: ``file``, ``edge`` (0 before, 1 after) and ``line``.

    ``begin`` and ``end`` are aggregates over the file's records, such as ``count``. A file without records has none.
    """
    found = df.groupBy(file).agg(begin.cast("string").alias("_b"), end.cast("string").alias("_e"), F.min(order).alias("_first"), F.max(order).alias("_last"))
    row = lambda edge, at, line: F.struct(F.lit(edge).alias("edge"), F.col(at).alias(order), F.col(line).alias("line"))
    return found.select(file, F.explode(F.array(row(0, "_first", "_b"), row(1, "_last", "_e"))).alias("_x")).select(file, "_x.*")


def assigned(df: DataFrame, index: str, values: list[tuple[int, object]], name: str, default: object = "") -> DataFrame:
    """Add a variable that is set between files: the value of the last (file index, value) at or before the row's file."""
    out = F.lit(default)
    for at, value in sorted(values, key=lambda x: x[0]):
        out = F.when(F.col(index) >= at, F.lit(value)).otherwise(out)
    return df.withColumn(name, out)


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files of a folder: ``path``, ``name``, ``size`` and ``mtime`` in seconds. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return files.select("path", name, F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each file: ``text`` and ``filename``."""
    return spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("filename"))


#: What stands for a backslash, a tab, a newline and a return in a table's file.
_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def escaped(value: Column) -> Column:
    for char, shown in _ESCAPES:
        value = F.replace(value, F.lit(char), F.lit(shown))
    return value


def unescaped(value: Column) -> Column:
    """What ``escaped`` was made of: pieces between doubled backslashes are read by themselves."""

    def plain(piece: Column) -> Column:
        for char, shown in _ESCAPES[1:]:
            piece = F.replace(piece, F.lit(shown), F.lit(char))
        return piece

    return F.array_join(F.transform(F.split(value, r"\\\\", -1), plain), "\\")


def read_table(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """Keys and values that ``sinks.write_table`` wrote, as texts."""
    at = F.instr("value", "\t")
    lines = spark.read.text(path).where(at > 0)
    return lines.select(
        unescaped(F.substring("value", F.lit(1), at - 1)).alias(key), unescaped(F.substring("value", at + 1, F.length("value"))).alias(value)
    )
