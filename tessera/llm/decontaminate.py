"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small, text_of, written

#: Units of measure and number words that count as parameters of a question.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
    "pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour "
    "hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent mph kph "
    "meter meters metre metres kilometer kilometers kilometre kilometres"
)
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
)

_KINDS = dict.fromkeys(UNITS.split(), "<unit>") | dict.fromkeys(NUMBER_WORDS.split(), "<num>")
_DIGIT = re.compile(r"\d")
_NAME = xxhash.xxh64_intdigest("<name>")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bits of the filter through which document windows go before the join: 16 MB whatever the benchmark's size.
FILTER_BITS = 1 << 27
_CACHE_WORDS = 500_000
#: Characters of text worked on at a time.
PART = 1_000_000
#: Counts as space, so that no word holds it.
SEP = "\x1f"


class Canon:
    """Words to canonical tokens, remembered while a task runs, up to a bound.

    A number becomes ``<num>``, a unit ``<unit>``, a capitalised word within a sentence ``<name>``;
    another word is itself, lower-cased and without the punctuation around it.
    """

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.plain: list[str] = []
        self.new: list[int] = []  # rows not yet in the table, four values each
        self.table = np.zeros((0, 4), np.uint64)

    def _add(self, word: str) -> int:
        letters = word.isalpha()
        bare = word if letters else _EDGES.sub("", word)
        low = bare.lower()
        token = _KINDS.get(low, low) if letters or not _DIGIT.search(low) else "<num>"
        name = token is low and bare[:1].isupper() and bare[1:].islower()
        own = xxhash.xxh64_intdigest(token)
        self.new += (own, _NAME if name else own, word[-1] in ".!?:", (token is not low) + 2 * name)
        row = self.ids[word] = len(self.plain)
        self.plain.append(low)
        return row

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts in a row: each one's canonical token's hash, whether it is a parameter,
        and its row here; and the count of words of each text.
        """
        if len(self.ids) > _CACHE_WORDS:
            self.__init__()
        ids, firsts, sizes = [], [], []
        for text in texts:
            before = len(ids)
            for line in text.split("\n"):
                if words := line.split():
                    firsts.append(len(ids))
                    ids += map(self.ids.get, words)
            if None in ids[before:]:
                ids[before:] = [self._add(w) if (i := self.ids.get(w)) is None else i for w in text.split()]
            sizes.append(len(ids) - before)
        at = np.array(ids, np.int64)
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, np.uint64).reshape(-1, 4)])
            self.new = []
        own = self.table[at]
        starts = np.zeros(len(at), bool)  # of a line, and so of a sentence
        starts[firsts] = True
        starts[1:] |= own[:-1, 2] > 0
        tokens = np.where(starts, own[:, 0], own[:, 1])
        slots = (own[:, 3] == 1) | ((own[:, 3] == 2) & ~starts)
        return tokens, slots, at, np.array(sizes, np.int64)


def windows(tokens: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` tokens within a text, and where it begins among all tokens."""
    n = len(tokens) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out * _BASE + tokens[i : n + i]) ^ (out >> np.uint64(29))
    inside = np.ones(n + k, bool)
    ends = np.cumsum(sizes)
    for i in range(1, k):  # would reach into the next text
        inside[(ends - i)[ends >= i]] = False
    where = np.flatnonzero(inside[:n])
    return out[where], where


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PART characters, a longer text in its own; each has a row at least."""
    start, total = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
        if i > start and total + size > PART:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _scan(rows: DataFrame, k: int, within=None) -> DataFrame:
    """A row for each template window: id, pos, hash, and the parameters in it as offset, SEP, value."""
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for part in _parts(batch):
                tokens, is_slot, own, sizes = canon.texts([x or "" for x in part.column("text").to_pylist()])
                hashes, at = windows(tokens, sizes, k)
                if within is not None:
                    bit = hashes % np.uint64(FILTER_BITS)
                    hit = within.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))
                    hit = np.flatnonzero(hit & np.uint64(1))
                    hashes, at = hashes[hit], at[hit]
                starts = np.cumsum(sizes) - sizes
                doc = np.searchsorted(starts, at, side="right") - 1
                slots = [
                    [f"{i}{SEP}{canon.plain[own[p + i]]}" for i in np.flatnonzero(is_slot[p : p + k]).tolist()]
                    for p in at.tolist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(doc)),
                        pa.array(at - starts[doc]),
                        pa.array(hashes.view(np.int64)),
                        pa.array(slots, pa.list_(pa.string())),
                        pa.array(sizes[doc]),
                    ],
                    ["id", "pos", "hash", "slots", "size"],
                )

    return rows.mapInArrow(scan, f"id {kind}, pos bigint, hash bigint, slots array<string>, size bigint")


def _filter(spark: SparkSession, items: DataFrame):
    """A broadcast bit set of the benchmark's window hashes, of FILTER_BITS bits."""
    low = f"pmod(hash, {FILTER_BITS}L)"  # the same low bits, signed or not
    words = (
        items.select(
            F.expr(f"shiftright({low}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({low} & 63 as int))").alias("b")
        )
        .groupBy("word")
        .agg(F.bit_or("b").alias("bits"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _both(item: Column, doc: Column) -> Column:
    return F.concat(F.substring_index(item, SEP, -1), F.lit(SEP), F.substring_index(doc, SEP, -1))


def digest(text_col: str) -> Column:
    """What stands for a text: whether it is contaminated depends on the text alone."""
    return F.unhex(F.md5(text_of(text_col)))


def _occurrences(votes: DataFrame, by: list[str], k: int) -> DataFrame:
    """For each group of votes: how many of the item's words count as covered, and what its parameters are like.

    Parameters are consistent if each value of the item stands for one value in the document (two may stand
    for the same one). If they aren't, only windows without parameters count.
    """
    pairs = F.array_distinct(F.flatten(F.collect_set("slots")))
    found = votes.groupBy(*by).agg(
        F.collect_set("ipos").alias("at"), F.collect_set(F.when(F.size("slots") == 0, F.col("ipos"))).alias("bare"), pairs.alias("pairs")
    )
    left = F.transform("pairs", lambda x: F.substring_index(x, SEP, 1))
    found = found.withColumn("slots_consistent", F.size(F.array_distinct(left)) == F.size("pairs"))
    counted = F.when(F.col("slots_consistent"), F.col("at")).otherwise(F.col("bare"))
    words = F.array_distinct(F.flatten(F.transform(counted, lambda p: F.sequence(p, p + k - 1))))
    same = F.forall("pairs", lambda x: F.substring_index(x, SEP, 1) == F.substring_index(x, SEP, -1))
    return found.select("digest", "item_id", "size", F.size(words).alias("covered"), "slots_consistent", same.alias("same"))


def text_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    similarity: float = 0.8,
    least_words: int = 8,
    gap: int = 2,
) -> DataFrame:
    """The same as ``contamination``, by ``digest`` of a text: digest, item_id, coverage, slots_consistent, contaminated."""
    if least_words < k:
        raise ValueError("least_words must be k or more")
    spark = docs.sparkSession
    own = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = written(
        _scan(own.where("id is not null"), k).select(
            F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "hash", F.col("slots").alias("islots"), "size"
        ),
        "benchmark-windows",
    )
    rows = docs.select(digest(text_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _scan(rows, k, _filter(spark, items)).drop("size")
    votes = (
        found.join(F.broadcast(items) if small(items) else items, "hash")
        .groupBy(F.col("id").alias("digest"), "item_id", "size", F.expr("pos - ipos").alias("diagonal"), "ipos")
        .agg(F.first(F.zip_with("islots", "slots", _both)).alias("slots"))
    )
    votes = written(
        votes.selectExpr("*", "count(*) over (partition by digest, item_id, diagonal) as votes").selectExpr(
            "*", f"coalesce(diagonal - lag(diagonal) over (partition by digest, item_id order by diagonal, ipos) > {gap}, true) as opens"
        ).selectExpr("*", "sum(int(opens)) over (partition by digest, item_id order by diagonal, ipos) as span"),
        "benchmark-votes",
    )
    key = ["digest", "item_id", "size", "span"]
    # of a span's votes for one place of the item, the one on the diagonal with the most counts
    merged = votes.groupBy(*key, "ipos").agg(F.max_by("slots", F.struct("votes", -F.col("diagonal"))).alias("slots"))
    straight = _occurrences(votes, ["digest", "item_id", "size", "diagonal"], k)
    best = (
        straight.unionByName(_occurrences(merged, key, k))
        .groupBy("digest", "item_id", "size")
        .agg(F.max(F.struct("covered", "slots_consistent", "same")).alias("b"))
        .select("digest", "item_id", "size", "b.*")
    )
    share = F.col("covered") / F.col("size")
    whole = (F.col("covered") >= F.col("size") - 1) & F.col("same")
    hit = F.when(F.col("size") >= least_words, share >= similarity).otherwise(whole)
    return best.select("digest", "item_id", share.alias("coverage"), "slots_consistent", hit.alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Find documents that hold a benchmark item, word for word or with other parameters.

    Words become canonical tokens, in which numbers, names and units are typed placeholders.
    Windows of ``k`` tokens of documents and items are joined by hash; document windows pass a
    fixed-size bit set of the benchmark's hashes first, so that next to nothing else is shuffled.
    Matches of a document and an item on one diagonal (position in the document less that in the
    item) are one occurrence; so are those on neighbouring diagonals, up to ``gap`` apart, as after
    an inserted or a missing word. Over the whole occurrence its parameters must be consistent: each value of the
    item stands for one value in the document; otherwise only its windows without
    parameters count. A document is contaminated by an item if the windows of one occurrence that count cover at
    least ``similarity`` of the item's words.

    Items below ``least_words`` words are only found whole, with one word missing at most and the same parameters.
    Items below ``k`` words can't be told from chance and are not looked for, nor are items with a null id.
    Null texts count as empty. Items that share an id count as one. Every document is judged by its
    text: ids may be null or repeat. Columns other than the four named are not read. Empty tables give an empty result.

    Returns a row for each document and item with common windows: doc_id, item_id, coverage (share
    of the item's words, of the best occurrence), slots_consistent (of that one), contaminated.
    """
    found = text_contamination(docs, benchmark, text_col, **options)
    ids = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
    return ids.join(found, "digest").select("doc_id", "item_id", "coverage", "slots_consistent", "contaminated")


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of ``docs``: its best matched item (the smallest among equals) or nulls, coverage, contaminated."""
    best = (
        text_contamination(docs, benchmark, text_col, **options)
        .groupBy("digest")
        .agg(F.min(F.struct(~F.col("contaminated"), -F.col("coverage"), "item_id", "coverage", "slots_consistent", "contaminated")).alias("b"))
        .select("digest", "b.item_id", "b.coverage", "b.slots_consistent", "b.contaminated")
    )
    best = written(best, "contaminated-texts")
    ids = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"))
    found = ids.join(F.broadcast(best) if small(best) else best, "digest", "left").drop("digest")
    return found.fillna({"coverage": 0.0, "contaminated": False})
