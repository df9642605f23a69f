"""SimHash fingerprints, and near duplicates among them by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, written
from tessera.llm.graph import components

BITS = 64
#: Blocks into which the fingerprints of crowded buckets are cut.
FINER = 11


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    tuples = zip(*(words[i:] for i in range(shingle)), strict=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(t), seed) for t in tuples), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 8192):  # bounds the memory a long text takes
        part = hashes[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null text counts as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, fp bigint")


def block_masks(blocks: int, equal: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of ``equal`` of ``blocks`` blocks."""
    ends = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(fps: DataFrame, distance: int = 4, blocks: int = 7, crowd: int = 100) -> DataFrame:
    """Links ``a``, ``b`` that connect distinct fingerprints ``fp`` exactly as all close pairs would.

    Two fingerprints with at most ``distance`` differing bits agree in at least ``blocks`` -
    ``distance`` of the blocks, so that they share the bucket of one choice of blocks. Buckets of up
    to ``crowd`` fingerprints are compared whole, and give a row for a fingerprint and not for a pair (``bucket_links``). Pairs within
    larger buckets would grow with the square of a group. Their fingerprints are cut into FINER blocks, of which
    again ``distance`` at most differ, so that buckets share more bits; those that are still crowded meet
    another way, as exact: each emits all values within distance/2 flipped bits. Two fingerprints
    share such a value if and only if they differ in at most ``distance`` bits, so that all that
    share one link to the smallest of them; at most as many as a ball has values can do so. ``distance`` must be even, and less than ``blocks``.
    """
    if distance % 2 or not 0 < distance < blocks:
        raise ValueError("distance must be even, over 0 and below blocks")
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks, blocks - distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("choice", "bits")).select(
        "fp", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("bits"))).alias("key")
    )
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = written(sizes.where("n > 1"), "buckets")
    large = buckets.where("n > 2").select("key", "n")
    shared = written(keyed.join(F.broadcast(large) if small(large) else large, "key"), "shared-buckets")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    links = buckets.where("n = 2").select("a", "b").where(close)
    links = links.unionByName(bucket_links(shared.where(F.col("n") <= crowd), distance))
    hot = written(shared.where(F.col("n") > crowd).select("fp").distinct(), "crowded-fingerprints")
    if not hot.isEmpty():
        finer = blocks < FINER and distance < FINER
        links = links.unionByName(near_links(hot, distance, FINER, crowd) if finer else ball_links(hot, distance // 2))
    return links.distinct()


def bucket_links(shared: DataFrame, distance: int) -> DataFrame:
    """Links of the fingerprints ``fp`` of each ``key``, few to a key, to the smallest that close pairs within the key lead to."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, least = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for fps in batch.column("all"):
                fps = np.sort(fps.values.to_numpy())
                first = _least_reachable(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance)
                moved = first != np.arange(len(fps))
                own.append(fps[moved])
                least.append(fps[first[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(least))], ["a", "b"])

    return shared.groupBy("key").agg(F.collect_set("fp").alias("all")).select("all").mapInArrow(stars, "a bigint, b bigint")


def _least_reachable(close: np.ndarray) -> np.ndarray:
    """The least index that each index reaches in a symmetric matrix with a true diagonal."""
    first = close.argmax(axis=1)
    while True:
        after = np.where(close, first, len(first)).min(axis=1)
        after = np.minimum(after, after[after])
        if (after == first).all():
            return first
        first = after


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints whose balls of ``radius`` flipped bits meet, as stars."""
    flips = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(BITS), r)]
    flips = np.array(flips, np.uint64).view(np.int64)

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                own = batch.column("fp").slice(start, 256).to_numpy(zero_copy_only=False)
                near = (own[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(flips))), pa.array(near)], ["fp", "near"])

    met = fps.mapInArrow(ball, "fp bigint, near bigint")
    stars = met.groupBy("near").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return stars.select(F.explode("all").alias("a"), "b").where("a <> b")


def blocks_for(rows: int, distance: int) -> int:
    """The least number of blocks, from ``distance`` + 3, whose buckets hold few of so many distinct fingerprints by chance."""
    blocks = distance + 3
    while rows > 1 << (BITS * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """Classes of near-duplicate documents: fingerprints with at most ``distance`` differing bits link.

    Documents with equal fingerprints, such as exact copies, are collapsed before any join, and get
    their class back by a join on the fingerprint. ``component_id`` is the smallest doc_id
    reachable over links. Null and empty texts have fingerprint 0. A null doc_id never names a
    class unless the class holds no other. Repeated rows give repeated results; an empty table
    gives an empty result; other columns are not read.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    blocks = blocks_for(distinct.count(), distance)
    linked = components(near_links(distinct.select("fp"), distance, blocks)).withColumnRenamed("node", "fp")
    classes = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = classes.join(named, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", _hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
