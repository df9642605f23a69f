"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node that has a link: columns ``node``, ``component``.

    ``links`` has columns ``a`` and ``b`` of one type; order, repeats and loops don't matter. Each
    round links all neighbours of a node to its smallest neighbour, first the larger neighbours
    and then the smaller ones, until the graph is a set of stars. The number of rounds grows with
    the logarithm of the longest path. Each round's links are written to the shared folder.
    """
    spark = links.sparkSession
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        dropped(spark, large)
        dropped(spark, edges)
        edges, (before, mark) = after, (mark, _mark(after))
        if before == mark:
            break
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select("b", "b").distinct().toDF("node", "component"))


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
