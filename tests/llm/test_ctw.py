"""Context-tree scores against a direct recursive version, and against the unigram base on held-out texts."""

import zlib
from collections import Counter
from math import exp, lgamma, log, log10

import numpy as np
import pytest

from tessera.llm import ctw
from tessera.llm.ctw import ctw_scores

DEPTH = 3


def plain(rows, depth):
    """Score by the definition: recursive weighted probabilities over suffix contexts, bit by bit."""
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    counts = {}

    def symbols(text):
        raw = (text or "").encode().lower()
        data = b"\xff" * depth + raw + b"\xff"
        for i in range(depth, len(data)):
            for b in range(8):
                yield data[i - depth : i], (1 << b) | (data[i] >> (8 - b)), data[i] >> (7 - b) & 1

    for i, text in rows:
        if not held[i]:
            for ctx, node, bit in symbols(text):
                for d in range(depth + 1):
                    counts.setdefault((ctx[depth - d :], node), [0, 0])[bit] += 1
    children = {}
    for ctx, node in counts:
        if ctx:
            children.setdefault((ctx[1:], node), []).append((ctx, node))

    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(3.141592653589793)

    weighted = {}

    def log_w(key):
        if key not in weighted:
            own = kt(*counts[key])
            if len(key[0]) == depth:
                weighted[key] = own
            else:
                below = sum(map(log_w, children.get(key, ())))
                top = max(own, below)
                weighted[key] = top + log(exp(own - top) + exp(below - top)) - log(2)
        return weighted[key]

    def one(ctx, node, d=0):
        key = (ctx[depth - d :], node)
        if key not in counts:
            return 0.5
        a, b = counts[key]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = exp(kt(a, b) - log(2) - log_w(key))
        return w * own + (1 - w) * one(ctx, node, d + 1)

    words = Counter()
    for i, text in rows:
        if not held[i]:
            words.update((text or "").encode().lower().split() + [b""])
    total, distinct = sum(words.values()), len(words)
    out = []
    for i, text in rows:
        own = (text or "").encode().lower().split() + [b""]
        score = sum(log10(p if bit else 1 - p) for c, n, bit in symbols(text) for p in [one(c, n)])
        base = sum(log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        out.append((i, held[i], len(own), sum(words[w] > 0 for w in own), total, base, score))
    return out


TEXTS = ["The cat sat on the mat.", "the dog sat\non the log", "Straße élan ñandú " * 3, "", None, "a" * 300, "x\x00y \x1f z"]


def test_against_the_definition(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, "the end"), (3, "the same id again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted(map(tuple, ctw_scores(docs, depth=DEPTH).drop("bits_per_byte").collect()), key=order)
    want = sorted(plain(rows, DEPTH), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("piece", [250_000, 3])
def test_against_the_definition_at_full_depth(spark, monkeypatch, piece):
    """Depth 5, as registered; very long and repeated texts, extra columns, and trees built in small parts."""
    monkeypatch.setattr(ctw, "PIECE", piece)
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(3, "long text " * 3000), (3, "long text " * 3000), (None, "again"), (None, "again")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, score string")
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted(map(tuple, ctw.ctw_scores(docs).drop("bits_per_byte").collect()), key=order)
    want = sorted(plain(rows, 5), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_trees_in_parts():
    """Cutting a context's grams into parts changes nothing."""
    rng = np.random.default_rng(3)
    grams = np.unique((rng.integers(0, 256, 3000) << 40) | (rng.integers(0, 256, 3000) << 24) | (0x6565 << 8) | rng.integers(0, 256, 3000))
    counts = rng.integers(0, 9, len(grams))
    parts = ctw.pieces(grams, counts, 100)
    assert len(parts) > 10 and sorted(np.concatenate([p[0] for p in parts]).tolist()) == list(range(len(grams)))
    one, many = (ctw.upper_levels(ctw.pieces(grams, counts, n), 5)[2] for n in (10**9, 100))
    assert all(np.allclose(one[x], many[x]) for x in ("keys", "zeros", "ones", "log_w"))


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame([(None, "abc")], "doc_id long, text string")
    assert ctw_scores(docs.limit(0)).count() == 0
    row = ctw_scores(docs).first()
    assert row.held_out and row.train_tokens == 0 and row.bits_per_byte == pytest.approx(8)


def test_held_out_texts_cost_less_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in ctw_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.5 * len(rows)
