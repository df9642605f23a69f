"""Quality model, decontamination, packing and the pipeline."""

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, ctw, line_dedup, packing, queries
from tessera.llm.decontaminate import contamination, verdicts
from tessera.llm.packing import best_bounds, pack
from tessera.llm.quality import FEATURES, features, fit, quality_scores

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) as quality")
    scores = [sorted((r.doc_id, r.score) for r in quality_scores(docs, x).collect()) for x in (labels, other)]
    assert scores[0] == scores[1]


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "", 6.0), (2, "word " * 50_000, 7.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    assert quality_scores(docs.limit(0), none).count() == 0
    assert all(len(features(t)) == len(FEATURES) and np.isfinite(features(t)).all() for t in (None, "", "\n\n", "é" * 99))


def test_additive_model_learns_an_interaction():
    random.seed(2)
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000], pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


QUESTION = "A train with 12 wagons leaves Berlin for Vienna and travels 250 miles in 5 hours before it stops in Berlin again"


def changed(**words):
    out = QUESTION
    for old, new in words.items():
        out = out.replace(old.strip("_"), new)
    return out


def test_decontamination_templates(spark):
    items = spark.createDataFrame([(7, QUESTION), (8, None), (9, "too short"), (None, QUESTION)], "item_id long, text string")
    rows = [
        (1, "before it all. " + QUESTION + " and more"),
        (2, "x\n" + changed(Berlin="Madrid", Vienna="Lisbon", _12="33", miles="kilometers")),
        (3, "x\n" + QUESTION.replace("Berlin", "Madrid", 1)),  # one name of the item stands for two
        (4, "nothing of the kind is here at all, only words"), (5, None), (6, ""), (None, QUESTION),
        (10, QUESTION.split(" before")[0]),
    ]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, item_id int")
    found = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert found[1].contaminated and found[1].coverage == 1 and found[1].item_id == 7
    assert found[2].contaminated and found[2].slots_consistent
    assert not found[3].contaminated and not found[3].slots_consistent
    assert not found[10].contaminated and 0.5 < found[10].coverage < 0.8
    got = {r.doc_id: r.contaminated for r in verdicts(docs, items).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 10: False, None: True}
    assert contamination(docs.limit(0), items).count() == contamination(docs, items.limit(0)).count() == 0


def test_decontamination_spans_and_short_items(spark):
    """Slots are checked over a whole occurrence: a word inserted between its parts doesn't hide that they differ."""
    items = spark.createDataFrame([(7, QUESTION), (8, "who wrote seven songs about winter"), (9, "only four words here")], "item_id long, text string")
    broken = QUESTION.replace("Berlin", "Madrid", 1)
    rows = [
        (1, "x\n" + broken.replace("travels", "slowly travels")), (2, "x\n" + QUESTION.replace("travels", "slowly travels")),
        (3, "he asked who wrote seven songs about winter and left"), (4, "he asked who wrote nine songs about winter"), (5, "only four words here"),
        (6, QUESTION.replace("Vienna", "Berlin")), (None, "x\n" + QUESTION), (1, "nothing of it"),
    ]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, digest binary")
    got = sorted(((r.doc_id, r.contaminated) for r in verdicts(docs, items).collect()), key=str)
    assert got == [(1, False), (1, False), (2, True), (3, True), (4, False), (5, False), (6, True), (None, True)]


def test_decontamination_recall_on_new_parameters(spark):
    """Questions drawn again with other numbers, names and units are found; with one value drawn twice, they aren't."""
    random.seed(9)
    names, units = ["Berlin", "Madrid", "Oslo", "Rome", "Lima", "Cairo", "Delhi", "Kyoto"], ["miles", "hours", "liters", "pounds", "days"]
    plain = "the train leaves and then stops near a small bridge before it turns back while people wait for some more news".split()
    items, docs, crossed = [], [], []
    for i in range(80):
        shape = random.sample(plain, 14)
        places = sorted(random.sample(range(1, 14), 4))
        kinds = [random.choice("nnau") for _ in places]
        draw = lambda: {k: {"n": str(random.randrange(2, 999)), "a": random.choice(names), "u": random.choice(units)}[t] for k, t in zip(places, kinds, strict=True)}  # noqa: E731, B023
        fill = lambda values: " ".join(values.get(k, w) for k, w in enumerate(shape))  # noqa: E731, B023
        own = draw()
        items.append((i, fill(own) + f" so what is {own[places[0]]} here"))
        new = draw()
        docs.append((i, "some words stand before it " + fill(new) + f" so what is {new[places[0]]} here and some after"))
    known = spark.createDataFrame(items, "item_id long, text string")
    got = verdicts(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()
    recall = sum(r.contaminated and r.item_id == r.doc_id for r in got) / len(docs)
    print(recall)
    assert recall >= 0.9


def test_decontamination_on_documents(spark):
    """Documents that hold an item's words in a row, by brute force."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join((t or "").split())
    texts = [flat(r.text) for r in items.collect()]
    want = {r.doc_id for r in docs.collect() if any(t in flat(r.text) for t in texts if len(t.split()) >= 8)}
    got = {r.doc_id for r in verdicts(docs, items).collect() if r.contaminated}
    assert want and want <= got and len(got - want) <= 0.01 * docs.count()


def test_best_bounds():
    random.seed(4)
    for _ in range(30):
        lengths = np.array(sorted(random.sample(range(0, 60), random.randrange(1, 8))))
        counts = np.array([random.randrange(1, 30) for _ in lengths])
        for buckets in (1, 2, 3):
            cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
            every = [c for c in combinations_with_replacement(lengths.tolist(), buckets) if c[-1] == lengths[-1]]
            assert cost(best_bounds(lengths, counts, buckets)) == min(map(cost, every))


@pytest.mark.parametrize("rows_per_group", [5000, 7])
def test_pack(spark, rows_per_group):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    got = pack(docs, rows_per_group=rows_per_group, budget=4000).collect()
    assert {r.doc_id: r.n_tokens for r in got} == sizes
    batches = {}
    for r in got:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    limits = sorted({r.bucket_tokens for r in got})
    values, counts = np.unique(list(sizes.values()), return_counts=True)
    best = best_bounds(values, counts, 8)
    pad = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(values, counts, strict=True))
    assert pad(best) <= pad(limits) <= 1.02 * pad(best) + 1
    for (bucket, batch), rows in batches.items():
        room = max(1, 4000 // max(rows[0].bucket_tokens, 1))
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) <= room
        assert len(rows) == room or (bucket, batch + 1) not in batches


def test_pack_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "w " * 99_999)], "doc_id long, text string")
    got = pack(docs).collect()
    assert len(got) == 4 and {r.n_tokens for r in got} == {0, 2, 99_999}
    assert pack(docs.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage against the operator's own brute-force properties, on the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] > seen[4] > 0
    assert not any(r.contaminated for r in verdicts(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect())
    packed = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(r.doc_id for r in docs.collect())


ODD = [
    (1, None), (2, ""), (3, " \n "), (4, "One short line.\nA line that stands here twice and is long enough to compare.\nOne short line."),
    (4, "the same id with another text in it and some more words to read"), (None, "One short line.\nA text without an id."), (5, "word " * 60_000),
    (6, "A line that stands here twice and is long enough to compare!\nand one more"),
    (7, "x\n" + QUESTION), (None, "y\n" + QUESTION), (7, "x\n" + QUESTION),
]
CLASHES = "score predicted held_out _text _id _drop drop n_lines n_dropped digest component_id fingerprint item_id row fp kept batch".split()


@pytest.fixture
def odd_dir(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in ODD], "doc_id long, text string, n_chars long")
    docs = docs.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(CLASHES)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, quality int").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd_dir, name):
    """Nulls, empty and long texts, repeated ids, clashing columns and no rows at all."""
    docs, stage = spark.read.parquet(f"{odd_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), odd_dir).count() == 0
    out = stage(spark, docs, odd_dir)
    if name == "packing":
        assert out.count() == len(ODD)
        return
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == i for r in got for i, c in enumerate(CLASHES))
    left = sorted(((r.doc_id, r.text) for r in got), key=str)
    if name == "quality":  # without labels the score is 0.5
        want = ODD
    elif name == "simhash":
        want = [(i, t) for i, t in ODD if i not in (2, 3)]
    elif name == "decontamination":
        want = [(i, t) for i, t in ODD if QUESTION not in (t or "")]
    else:
        twice = "A line that stands here twice and is long enough to compare."
        changed = {(4, ODD[3][1]): f"One short line.\n{twice}", (6, ODD[7][1]): "and one more"}
        want = [(i, changed.get((i, t), t)) for i, t in ODD]
        assert all(r.n_chars == len(r.text or "") for r in got)
    assert left == sorted(want, key=str)


def test_pipeline_on_odd_rows(spark, odd_dir):
    assert corpus_pipeline.run(spark, odd_dir).count() > 0


def test_pack_marks_what_is_over_the_budget(spark):
    docs = spark.createDataFrame([(1, "w " * 50_000), (2, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.over_budget for r in pack(docs).collect()} == {1: True, 2: False}


def test_quality_learns_from_repeated_rows_once(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    once = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    assert once == {r.doc_id: r.score for r in quality_scores(docs.union(docs).union(docs), labels).collect()}


def test_scratch_folder_is_not_the_drivers_on_a_cluster(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: None if "checkpoint" in k else "file:/home/x/spark-warehouse")})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})  # noqa: N815

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Cluster)


@pytest.mark.parametrize("name", ["op1_ctw", "op3_packing", "op4_simhash", "op6_url_filter", "op7_line_dedup", "op9_decontamination"])
def test_sizes_that_switch_the_plan_do_not_change_the_result(spark, monkeypatch, name):
    """Broadcast or shuffled, in few blocks or many: the rows are the same."""
    sf = "/root/testdata/sf0.001"
    plain = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    want = plain(queries.queries()[name](spark, sf))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 3)
    monkeypatch.setattr(packing, "GROUPS", 2)
    monkeypatch.setattr(ctw, "PENDING", 20_000)
    monkeypatch.setattr(ctw, "BLOCK", 40_000)
    got = plain(queries.queries()[name](spark, sf))
    if name == "op3_packing":  # which batch a row is in depends on its group
        got, want = ([(r[0], r[1], r[2], r[3], r[6], r[7]) for r in x] for x in (got, want))
    assert got == want
