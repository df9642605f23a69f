"""Language-model scoring by context-tree weighting over bytes."""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, text_of, written

#: Stands before and after each text; no UTF-8 text has this byte.
EDGE = 0xFF
#: Bytes of text worked on at a time.
CHUNK = 500_000
#: Grams that wait to be merged into those of a block, about.
PENDING = 1_000_000
#: Grams whose trees are held at a time, about.
PIECE = 250_000
#: Bytes of text in a block, about: what one task reduces to its distinct grams.
BLOCK = 36_000_000

_LN_HALF = np.array([lgamma(i + 0.5) for i in range(4096)])
_LN_ONE = np.array([lgamma(i + 1.0) for i in range(4096)])


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) of whole n, by Stirling's series where the table ends."""
    small = n < len(table)
    x = np.where(small, len(table), n) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)
    return np.where(small, table[np.where(small, n, 0).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a bit sequence with so many zeros and ones."""
    return (
        _lgamma(zeros, _LN_HALF, 0.5) + _lgamma(ones, _LN_HALF, 0.5) - _lgamma(zeros + ones, _LN_ONE, 1.0) - np.log(np.pi)
    )


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text, and the edge after it, the ``depth`` bytes before it and itself.

    Packed into an integer, the oldest byte highest. Also where each text's symbols begin.
    """
    edge = bytes([EDGE])
    data = np.frombuffer((edge * depth).join([b"", *(t + edge for t in texts)]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    packed = np.zeros(len(data) - depth, np.int64)
    for i in range(depth + 1):
        packed <<= 8
        packed |= data[i : len(data) - depth + i]
    inside = np.ones(len(packed), bool)  # symbols, and not the edges that pad the next text
    ends = np.cumsum(sizes + depth)
    for i in range(1, depth + 1):
        at = ends[:-1] - i
        inside[at] = False
    return packed[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def chunks(items: Iterable[tuple], size: int = CHUNK) -> Iterator[list[tuple]]:
    """Split (text, ...) tuples so that each part has about ``size`` bytes, a longer text its own part."""
    part, total = [], 0
    for item in items:
        if part and total + len(item[0]) > size:
            yield part
            part, total = [], 0
        part.append(item)
        total += len(item[0])
    if part:
        yield part


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in counts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    n = np.concatenate([n for _, n in counts])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[dict[str, np.ndarray]]:
    """Nodes of the context trees from ``depth`` up to ``least``, of grams with their counts.

    There is a tree for each bit of a symbol and the bits before it, 255 in all; a node is a context
    of ``d`` bytes in such a tree. The weighted probability of a node is that of its own KT
    estimate and of its children's product, half and half; at ``depth`` it is the KT estimate.
    """
    symbol = grams & 255
    tree = np.stack([(1 << b) | (symbol >> (8 - b)) for b in range(8)], axis=1)
    bit = np.stack([(symbol >> (7 - b)) & 1 for b in range(8)], axis=1).ravel()
    keys, at = np.unique((((grams >> 8) << 8)[:, None] | tree).ravel(), return_inverse=True)
    weight = np.repeat(counts, 8).astype(np.float64)
    zeros, ones = np.bincount(at, weight * (1 - bit), len(keys)), np.bincount(at, weight * bit, len(keys))
    own = log_kt(zeros, ones)
    found = [{"keys": keys, "at": at, "bit": bit, "zeros": zeros, "ones": ones, "log_w": own, "weight": np.ones(len(keys))}]
    for d in range(depth - 1, least - 1, -1):
        found.append(parents(found[-1], d))
    return found


def parents(child: dict[str, np.ndarray], d: int) -> dict[str, np.ndarray]:
    """The nodes one byte of context up, at depth ``d``; ``weight`` is the share of a node's own estimate."""
    keys, at = np.unique(child["keys"] & ((1 << (8 * d + 8)) - 1), return_inverse=True)
    zeros, ones = (np.bincount(at, child[x], len(keys)) for x in ("zeros", "ones"))
    own, below = log_kt(zeros, ones), np.bincount(at, child["log_w"], len(keys))
    log_w = np.logaddexp(own, below) - np.log(2)
    weight = np.exp(own - np.log(2) - log_w)
    return {"keys": keys, "at": at, "zeros": zeros, "ones": ones, "log_w": log_w, "weight": weight}


def mixed(node: dict[str, np.ndarray], mean: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry the mixture one depth down: the sum so far of weighted estimates of a 1, and the weight left."""
    kt = (node["ones"] + 0.5) / (node["zeros"] + node["ones"] + 1)
    return mean + rest * node["weight"] * kt, rest * (1 - node["weight"])


def pieces(grams: np.ndarray, counts: np.ndarray, size: int | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams of one context of two bytes, dealt by the byte before it into parts of about ``size``, PIECE unless given.

    Where each part's grams stand, the grams and their counts. A part has whole subtrees from depth 3 on.
    """
    byte = (grams >> 24) & 255
    order = np.argsort(byte, kind="stable")
    ends = np.cumsum(np.bincount(byte, minlength=256))
    cuts, last = [], 0
    for end in ends.tolist():
        if end - last >= (size or PIECE):
            cuts.append(end)
            last = end
    return [(at, grams[at], counts[at]) for at in np.split(order, cuts) if len(at)]


def joined_nodes(levels_of: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The nodes of all parts, one part after the other."""
    return {x: np.concatenate([n[x] for n in levels_of]) for x in ("keys", "zeros", "ones", "log_w", "weight")}


def upper_levels(parts, depth: int) -> tuple[list, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """All levels of the only part (else none are kept), the nodes of depth 3, or ``depth`` if less, and those of depth 2."""
    found = [levels(g, n, depth, min(3, depth)) if i == 0 else levels(g, n, depth, min(3, depth))[-1:] for i, (_, g, n) in enumerate(parts)]
    third = joined_nodes([f[-1] for f in found])
    return found[0] if len(parts) == 1 else [], third, parents(third, 2) if depth > 2 else third


def gram_log10(grams: np.ndarray, counts: np.ndarray, depth: int, top_keys, top_mean, top_rest) -> np.ndarray:
    """log10 probability of each gram's symbol after its context, mixed over all depths, for grams of one context of two bytes.

    The ``top_`` arrays have the mixture down to depth 1, by (byte before, tree). The trees below depth 2 are worked on in parts.
    """
    parts, out = pieces(grams, counts), np.zeros(len(grams))
    only, third, second = upper_levels(parts, depth)
    where = np.searchsorted(top_keys, second["keys"] & 0xFFFF)
    mean, rest = top_mean[where], top_rest[where]
    if depth > 2:
        mean, rest = mixed(second, mean, rest)
        mean, rest = mean[second["at"]], rest[second["at"]]
    start = 0
    for at, own, n in parts:
        found = only or levels(own, n, depth, min(3, depth))
        end = start + len(found[-1]["keys"])
        m, r = mean[start:end], rest[start:end]
        start = end
        for i in range(len(found) - 1, -1, -1):
            m, r = mixed(found[i], m, r)
            if i:  # to the nodes below
                m, r = m[found[i]["at"]], r[found[i]["at"]]
        one = m[found[0]["at"]]
        out[at] = np.log10(np.where(found[0]["bit"] == 1, one, 1 - one)).reshape(-1, 8).sum(axis=1)
    return out


class Lookup:
    """Values by integer key, found by a hash table of first comers and by bisection for the others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(10, int(len(keys)).bit_length() + 1))
        self.slot = np.full(1 << int(64 - self.shift), 0, np.int32)
        self.slot[self._hash(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def ctw_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 5,
    folds: int = 10,
    smoothing: float = 0.1,
) -> DataFrame:
    """Score every whole text, A-Z lower-cased, by context-tree weighting learned from the training fold.

    Each byte is coded bit by bit. For each bit a tree over the preceding 0 to ``depth`` bytes mixes
    the KT estimates of all depths, weighted by how well each predicts the training texts. Texts are
    learned from unless crc32(id as text) mod ``folds`` is 0. The base score is a unigram model of
    space-separated words, with an end token after each text.

    Documents are dealt into blocks of about BLOCK bytes by hash, a partition for each. Each block is reduced to its distinct grams (a byte and
    the ``depth`` before it) and words with training counts; only those are summed over the
    corpus, and their probabilities return to the blocks that have them. Grams are grouped by the
    two bytes before the symbol, and the trees of a group are built part by part, by the byte before those. Only the nodes of depth 1, at most 65,280, go to the driver and to all executors.

    Null text counts as empty: its end is scored. A null id is in the held-out fold. Repeated rows are
    learned from and scored each. With no training text every bit has probability 1/2. An empty
    table gives an empty result. Other columns are not read.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    blocks = max(8, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK + 1)
    rows = rows.select(
        "doc_id",
        "text",
        (fold(F.col("doc_id"), folds) == 0).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )
    rows = rows.repartitionById(blocks, "block")
    stats = written(
        rows.groupBy("block").applyInArrow(
            lambda table: _block_stats(table, depth), "block int, gram bigint, token binary, n bigint"
        ),
        "block-statistics",
    )
    grams = written(
        stats.where("gram is not null")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("context", F.expr("cast(shiftright(gram, 8) & 65535 as int)")),
        "grams",
    )
    tokens = stats.where("token is not null").groupBy("token").agg(F.sum("n").alias("c"))
    tokens = written(tokens, "tokens")
    total, distinct = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()

    shape = "key bigint, zeros double, ones double, log_w double"
    second = grams.groupBy("context").applyInArrow(lambda t: _up_grams(t, depth), shape)
    first = second.withColumn("byte", F.expr("cast(shiftright(key, 8) & 255 as int)"))
    first = first.groupBy("byte").applyInArrow(_up_nodes, shape).toPandas().sort_values("key")
    top = spark.sparkContext.broadcast(_top(first))
    scored = grams.groupBy("context").applyInArrow(
        lambda t: pa.table({
            "gram": t.column("gram"),
            "value": gram_log10(t.column("gram").to_numpy(), t.column("n").to_numpy(), depth, *top.value),
        }),
        "gram bigint, value double",
    )
    answers = (
        stats.where("gram is not null")
        .join(scored, "gram")
        .select("block", "gram", F.lit(None).cast("binary").alias("token"), "value")
        .unionByName(
            stats.where("token is not null")
            .join(tokens, "token")
            .select("block", F.lit(None).cast("bigint").alias("gram"), "token", F.col("c").cast("double").alias("value"))
        )
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double, bits_per_byte double"
    )
    return (
        rows.groupBy("block")
        .cogroup(answers.repartitionById(blocks, "block").groupBy("block"))
        .applyInArrow(lambda a, b: _block_scores(a, b, depth, total, distinct, smoothing), schema)
    )


def _released() -> None:
    """Give what a block has taken back to the system: a worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _texts(table: pa.Table) -> Iterator[tuple[bytes, bool]]:
    for t, h in zip(table.column("text"), table.column("held_out"), strict=True):
        yield t.as_py().encode("utf-8", "surrogatepass").lower(), h.as_py()


def _block_stats(table: pa.Table, depth: int) -> pa.Table:
    """A block's distinct grams and words, with their counts in training texts."""
    found, words = [], Counter()
    for part in chunks(_texts(table), 4 * CHUNK):
        for held_out in (False, True):
            texts = [t for t, h in part if h == held_out]
            if not texts:
                continue
            keys, n = np.unique(grams_of(texts, depth)[0], return_counts=True)
            found.append((keys, np.zeros_like(n) if held_out else n))
            for text in texts:
                own = text.split()
                if held_out:
                    words.update(dict.fromkeys(own, 0))
                else:
                    words.update(own)
        words[b""] += sum(not h for _, h in part)  # the end token
        if sum(len(k) for k, _ in found[1:]) > PENDING:
            found = [_merged(found)]
    keys, n = _merged(found)
    tokens = list(words)
    block = table.column("block")[0].as_py()
    del found, part, texts
    _released()
    return pa.table({
        "block": pa.array(np.full(len(keys) + len(tokens), block, np.int32)),
        "gram": pa.concat_arrays([pa.array(keys), pa.nulls(len(tokens), pa.int64())]),
        "token": pa.concat_arrays([pa.nulls(len(keys), pa.binary()), pa.array(tokens, pa.binary())]),
        "n": pa.concat_arrays([pa.array(n), pa.array([words[t] for t in tokens], pa.int64())]),
    })


def _nodes(level: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({
        "key": pa.array(level["keys"]),
        **{x: pa.array(level[x], pa.float64()) for x in ("zeros", "ones", "log_w")},
    })


def _up_grams(table: pa.Table, depth: int) -> pa.Table:
    """Nodes of depth 2 from a group of grams."""
    return _nodes(upper_levels(pieces(table.column("gram").to_numpy(), table.column("n").to_numpy()), depth)[2])


def _up_nodes(table: pa.Table) -> pa.Table:
    """Nodes of depth 1 from those of depth 2."""
    child = {x: table.column(x).to_numpy() for x in ("zeros", "ones", "log_w")} | {"keys": table.column("key").to_numpy()}
    return _nodes(parents(child, 1))


def _top(first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of depth 1 with the mixture over depths 0 and 1."""
    child = {x: first[x].to_numpy(np.float64) for x in ("zeros", "ones", "log_w")} | {"keys": first["key"].to_numpy(np.int64)}
    if not len(child["keys"]):
        return child["keys"], child["zeros"], child["ones"]
    root = parents(child, 0)
    mean, rest = mixed(root, np.zeros(len(root["keys"])), np.ones(len(root["keys"])))
    own = np.exp(log_kt(child["zeros"], child["ones"]) - np.log(2) - child["log_w"])
    return child["keys"], *mixed(child | {"weight": own}, mean[root["at"]], rest[root["at"]])


def _block_scores(
    docs: pa.Table, answers: pa.Table, depth: int, total: int, distinct: int, smoothing: float
) -> pa.Table:
    """Score a block's texts with the values of its grams and words."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    of_words = answers.filter(answers.column("token").is_valid()).select(["token", "value"])
    logs = Lookup(answers.column("gram").fill_null(-1).to_numpy(), answers.column("value").to_numpy())
    counts = dict(zip(of_words.column("token").to_pylist(), of_words.column("value").cast(pa.int64()).to_pylist(), strict=True))
    over = np.log10(total + smoothing * (distinct + 1))
    out = [[] for _ in range(5)]
    for part in chunks(_texts(docs)):
        texts = [t for t, _ in part]
        grams, starts = grams_of(texts, depth)
        sums = np.add.reduceat(logs(grams), starts)
        for text, score in zip(texts, sums.tolist(), strict=True):
            c = np.array([counts[w] for w in text.split()] + [counts[b""]], np.float64)
            out[0].append(len(c))
            out[1].append(int(np.count_nonzero(c)))
            out[2].append(float((np.log10(c + smoothing) - over).sum()))
            out[3].append(score)
            out[4].append(-score * float(np.log2(10)) / (len(text) + 1))
    del logs, counts, of_words
    _released()
    columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(out[0]), pa.array(out[1])]
    columns += [pa.array(np.full(docs.num_rows, total, np.int64)), pa.array(out[2]), pa.array(out[3]), pa.array(out[4])]
    return pa.table(columns, names=names)
