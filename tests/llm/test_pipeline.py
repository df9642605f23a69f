"""The pipeline against a plain Python version of its stages, on the smallest tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm.packing import best_bounds
from tessera.llm.quality import AdditiveModel, features, fit, quality_scores
from tessera.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_scores(rows, labels):
    """Score by id: the model is fitted to labelled rows outside the held-out fifth, and read entry by entry."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = [(features(t), labels[i]) for i, t in sorted(rows.items()) if i in labels and not held(i)]
    model = fit(np.array([x for x, _ in known]), np.array([y for _, y in known], float))

    def score(x):
        at = lambda cuts, v: sum(c <= v for c in cuts)
        total = model.base + sum(table[at(cuts, v)] for cuts, table, v in zip(model.cuts, model.tables, x, strict=True))
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[at(model.coarse[i], x[i]), at(model.coarse[j], x[j])]
        return 1 / (1 + np.exp(-total))

    return {i: score(features(t)) for i, t in rows.items()}


def plain_lines(rows):
    """Text by id without lines that repeat an earlier one, exactly or within the edits that its length allows."""
    allowed = lambda n: (n >= 32) + (n >= 40) + (n >= 60)
    places = [(i, n, x.strip(" ")) for i, t in sorted(rows.items()) for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    texts = sorted({p[2] for p in places})
    sets, long = Sets(texts), [t for t in texts if len(t) >= 32]
    chars = {c: k for k, c in enumerate(sorted(set("".join(long))))}
    counts = np.zeros((len(long), len(chars)), np.int32)
    for k, t in enumerate(long):
        for c, n in Counter(t).items():
            counts[k, chars[c]] = n
    for k, a in enumerate(long):  # an edit changes two counts at most
        for j in np.flatnonzero(np.abs(counts[k + 1 :] - counts[k]).sum(axis=1) <= 6) + k + 1:
            b = long[j]
            if edits(a, b) <= allowed(min(len(a), len(b))):
                sets.join(a, b)
    first = {}
    for i, n, t in places:
        first.setdefault(sets.find(t), (i, n))
    drop = {(i, n) for i, n, t in places if first[sets.find(t)] != (i, n)}
    out = {}
    for i, t in rows.items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in drop)
        if left.strip(" \t\n\v\f\r") or not any(d[0] == i for d in drop):
            out[i] = left
    return out


def plain_near_copies(rows):
    fps = {i: fingerprint(t) for i, t in rows.items()}
    every = sorted(set(fps.values()))
    sets = Sets(every)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    least = {}
    for i in sorted(fps):
        least.setdefault(sets.find(fps[i]), i)
    return {i: t for i, t in rows.items() if least[sets.find(fps[i])] == i}


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    return docs, {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}, [r.text for r in items.collect()]


def test_scores(spark, tables):
    docs, rows, marks, _ = tables
    want = plain_scores(rows, marks)
    got = {r.doc_id: r.score for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert AdditiveModel(0.0).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_every_stage_and_the_whole(spark, tables):
    docs, rows, marks, items = tables
    flat = lambda t: " ".join(t.split())
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        out = corpus_pipeline.written(stages[name](spark, docs, SF), name)
        return out, {r.doc_id: r.text or "" for r in out.select("doc_id", "text").collect()}

    scores = plain_scores(rows, marks)
    docs, got = run("quality")
    assert got == {i: t for i, t in rows.items() if scores[i] >= 0.3} and 0 < len(got) < len(rows)
    want = plain_lines(got)
    docs, got = run("line_dedup")
    assert got == want
    want = plain_near_copies(got)
    docs, got = run("simhash")
    assert got == want
    leaks = {i for i, t in got.items() if any(flat(x) in flat(t) for x in items)}
    before, (docs, got) = got, run("decontamination")
    assert leaks and not leaks & set(got) and len(before) - len(got) - len(leaks) <= 0.01 * len(before)
    sizes = {i: len(t.split()) for i, t in got.items()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in packed} == sizes
    values, counts = np.unique(list(sizes.values()), return_counts=True)
    bounds = best_bounds(values, counts, 8)
    pad = sum(min(b for b in bounds if b >= n) - n for n in sizes.values())
    assert pad <= sum(r.padding for r in packed) <= 1.02 * pad + 1
