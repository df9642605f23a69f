"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fold, smallest_hashes

FEATURES = (
    "log_chars", "word_length", "upper_ratio", "symbol_ratio", "digit_ratio", "other_ratio", "space_ratio",
    "distinct_words", "top_word", "doubled_words", "repeated_lines", "line_length", "entropy", "stops", "bangs",
    "symbol_ends", "bars", "long_words",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOPS = np.isin(_BYTES, [ord(c) for c in ".,;:?'"])
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~(_UPPER | _LOWER | _DIGIT | _STOPS)
_MARKS = frozenset(b"#$%&*@^~+=<>_\\{}[]")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, seen = max(len(words), 1), Counter(words)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    share = counts[counts > 0] / size
    return [
        float(np.log1p(len(raw))),
        sum(map(len, words)) / n,
        upper / max(upper + lower, 1),
        int(counts[_SYMBOL].sum()) / size,
        int(counts[_DIGIT].sum()) / size,
        int(counts[128:].sum()) / size,
        int(counts[_SPACE].sum()) / size,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        float(np.log1p(len(words) / max(len(lines), 1))),
        float(-(share * np.log2(share)).sum()) if raw else 0.0,
        int(counts[46] + counts[63]) / n,
        int(counts[33]) / n,
        sum(c for w, c in seen.items() if w[-1] in _MARKS) / n,
        int(counts[124]) / n,
        sum(c for w, c in seen.items() if len(w) > 24) / n,
    ]


def _leaves(gain: np.ndarray, weight: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: each bin's mean residual after up to ``depth`` levels of cuts."""
    total_g, total_w = gain.sum(), weight.sum()
    flat = np.full(len(gain), total_g / (total_w + 1.0))
    if depth == 0 or len(gain) < 2:
        return flat
    left_g, left_w = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
    right_g, right_w = total_g - left_g, total_w - left_w
    better = np.where(
        (left_w >= least) & (right_w >= least), left_g**2 / (left_w + 1) + right_g**2 / (right_w + 1), -1.0
    )
    at = int(better.argmax())
    if better[at] <= total_g**2 / (total_w + 1):
        return flat
    return np.concatenate([
        _leaves(part_g, part_w, depth - 1, least)
        for part_g, part_w in ((gain[: at + 1], weight[: at + 1]), (gain[at + 1 :], weight[at + 1 :]))
    ])


def _quadrants(gain: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table of two features into four: its gain and each cell's mean residual."""
    g, w = gain.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    rows_g, cols_g, rows_w, cols_w = g[:-1, -1:], g[-1:, :-1], w[:-1, -1:], w[-1:, :-1]
    g4 = [g[:-1, :-1], rows_g - g[:-1, :-1], cols_g - g[:-1, :-1], g[-1, -1] - rows_g - cols_g + g[:-1, :-1]]
    w4 = [w[:-1, :-1], rows_w - w[:-1, :-1], cols_w - w[:-1, :-1], w[-1, -1] - rows_w - cols_w + w[:-1, :-1]]
    score = sum(a**2 / (b + 1.0) for a, b in zip(g4, w4, strict=True))
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    a, b, c, d = (float(x[i, j] / (y[i, j] + 1.0)) for x, y in zip(g4, w4, strict=True))
    table = np.empty_like(gain)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = a, b, c, d
    return float(score[i, j]), table


@dataclass
class AdditiveModel:
    """Lookup tables by bin of one feature, and by bins of chosen pairs of features."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _bins(cuts: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: a sum of table entries, through the logistic function."""
        out = np.full(len(x), self.base)
        for bins, table in zip(self._bins(self.cuts, x), self.tables, strict=True):
            out += table[bins]
        bins = self._bins(self.coarse, x)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-out))


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.15, depth: int = 2, pairs: int = 6
) -> AdditiveModel:
    """Boost shallow trees on one feature after the other, in cycles, then on the best pairs of features.

    Without both labels present the score is the same for all: (ones + 1) / (rows + 2).
    """
    rate_one = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(rate_one / (1 - rate_one))))
    if not 0 < y.sum() < len(y):
        return model
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    model.cuts = [np.unique(np.quantile(x[:, i], steps)) for i in range(x.shape[1])]
    model.coarse = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, 17)[1:-1])) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    fine, coarse = model._bins(model.cuts, x), model._bins(model.coarse, x)
    out, least = np.full(len(y), model.base), max(5.0, len(y) / 2000)
    for _ in range(rounds):
        for b, table in zip(fine, model.tables, strict=True):
            p = 1 / (1 + np.exp(-out))
            gain = np.bincount(b, y - p, len(table))
            step = rate * _leaves(gain, np.bincount(b, p * (1 - p), len(table)), depth, least / 50)
            np.clip(step, -1, 1, out=step)
            table += step
            out += step[b]

    def cells(i: int, j: int) -> tuple[float, np.ndarray]:
        p, n = 1 / (1 + np.exp(-out)), len(model.coarse[j]) + 1
        shape, at = (len(model.coarse[i]) + 1, n), coarse[i] * n + coarse[j]
        size = shape[0] * n
        return _quadrants(
            np.bincount(at, y - p, size).reshape(shape), np.bincount(at, p * (1 - p), size).reshape(shape)
        )

    usable = [i for i in range(x.shape[1]) if len(model.coarse[i])]
    ranked = sorted(combinations(usable, 2), key=lambda ij: -cells(*ij)[0])
    model.pairs = ranked[:pairs]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = np.clip(rate * cells(i, j)[1], -1, 1)
            table += step
            out += step[coarse[i], coarse[j]]
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    folds: int = 5,
    threshold: float = 0.3,
    sample: int = 20_000,
) -> DataFrame:
    """Score every whole text from 0 to 1 for how likely ``labels.quality`` is 1.

    Only labels of documents whose crc32(id as text) mod ``folds`` is not 0 are learned from, and of
    those at most ``sample``, the ones with the smallest hash of the id: the fit on the driver is
    bounded, whatever the size of the corpus. Labels other than 0 and 1 are ignored; of a document
    with several labels the largest counts. Scores use features of the text alone.

    Null text counts as empty and gets a score like any text; a null id is in the held-out fold.
    Repeated rows are scored alike, and learned from once. Without labels every score is 0.5. ``keep`` names columns
    passed through, none of them doc_id, _text or a name that is returned; others are not read. Features are computed in the pass
    that scores, so that nothing is shuffled but the labels.

    Returns doc_id, held_out, score, predicted (1 from ``threshold`` on) and ``keep``.
    """
    held_out = fold(F.col("doc_id"), folds) == 0
    marked = labels.where("quality in (0, 1)").where(~held_out).select("doc_id", F.col("quality").alias("_y"))
    marked = (
        smallest_hashes(marked, "doc_id", sample, marked.count())
        .groupBy("doc_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    # of rows that repeat an id, one text is learned from
    learned = rows.select("doc_id", "_text").join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    learned = learned.select("_text", "_y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(x.as_py()) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.list_(pa.float64())), batch.column("_y")], ["_x", "_y"]
            )

    known = learned.mapInArrow(measure, f"_x array<double>, _y {learned.schema['_y'].dataType.simpleString()}").toPandas()
    x = np.array(known["_x"].tolist(), np.float64).reshape(len(known), len(FEATURES))
    model = fit(x, known["_y"].to_numpy(np.float64)) if len(known) else AdditiveModel(0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("_text")], np.float64)
            scores = pa.array(model.scores(x.reshape(batch.num_rows, len(FEATURES))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), scores, *(batch.column(c) for c in keep)], ["doc_id", "score", *keep]
            )

    fields = [rows.schema["doc_id"], T.StructField("score", T.DoubleType()), *(rows.schema[c] for c in keep)]
    return rows.mapInArrow(score, T.StructType(fields)).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
        *keep,
    )
