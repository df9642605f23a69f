"""Helpers shared by the training-data operators: scratch tables and input shaping."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest table, in rows, that an operator broadcasts after counting it; beyond it joins shuffle.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; the warehouse where it is unset.

    A warehouse on the driver's own disk is refused on a cluster, as executors don't share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if re.match(r"file:|/", base) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {base} is the driver's own")
    return f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage: a lost executor costs the tasks that read the table, not the work
    that made it. Tables are removed when the application ends, by ``dropped``, or at the end of ``temporary``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that ``written`` makes in this block when it ends, but for the one given to what it yields."""
    start, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles())
        return df

    yield keep
    for spark, path in _written[start:]:
        if path.rsplit("/", 1)[-1] not in kept:
            _delete(spark, path)
    _written[start:] = [x for x in _written[start:] if x[1].rsplit("/", 1)[-1] in kept]


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned and that no plan reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have stopped already
            return


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def smallest_hashes(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """Rows with the smallest hash of ``key``: all of them if ``total``, the count of rows, is small, else about 1.2 times ``n``.

    A filter, so that a bounded sample can be sorted afterwards without ``n`` rows of every partition in one task.
    """
    share = min(1.0, 1.2 * n / max(total, 1))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 40)) < int(share * (1 << 40)))


def small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a table, already written, has few enough rows to broadcast: ``rows``, or BROADCAST_ROWS."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows
