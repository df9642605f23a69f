"""Exact, SimHash and line deduplication against plain Python on whole small tables and on edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup as ld
from tessera.llm import queries
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.graph import components
from tessera.llm.simhash import ball_links, fingerprint, near_links, simhash_dedup

SF = "/root/testdata/sf0.01"
LONG = "one two three four five six seven eight nine ten " * 900
ODD = [
    (1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "ab "), (6, "a b"), (7, LONG), (8, LONG + "x"), (9, LONG),
    (9, LONG), (None, "a b"), (10, "only three words"), (11, "Only THREE words"),
]


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


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", True) for i, t in ODD], "doc_id long, text string, digest string, kept boolean")


@pytest.mark.parametrize("counters", [1000, 3])
@pytest.mark.parametrize("table", ["documents", "odd"])
def test_exact(spark, odd, table, counters):
    docs = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    groups, want = defaultdict(list), []
    for r in docs.collect():
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()
        groups[digest].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    for digest, rows in groups.items():
        keep = min(rows)[2]
        want += [(i, keep, len(rows), i == keep, digest) for _, _, i in rows]
    got = [tuple(r) for r in exact_dedup(docs, counters=counters).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_empty(odd):
    assert exact_dedup(odd.limit(0)).count() == 0


def test_components(spark):
    random.seed(5)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 460)]
    sets = Sets(range(500))
    for a, b in links:
        sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: sets.find(n) for a, b in links if a != b for n in (a, b)}


def classes(fps, distance=4):
    """Class by fingerprint."""
    every = sorted(set(fps))
    sets = Sets(every)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                sets.join(a, b)
    return {a: sets.find(a) for a in every}


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_simhash(spark, odd, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    of, least = classes([f for _, f in rows]), {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, f"{f:016x}", least.get(of[f])) for i, f in rows], key=str)


def test_fingerprint_by_definition():
    import xxhash

    text = "The cat\tsat on the MAT and the cat sat on the mat again"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(text) == want and fingerprint("") == fingerprint(None) == 0


@pytest.mark.parametrize("crowd", [100, 2])
def test_crowded_fingerprints(spark, crowd):
    """A family around one fingerprint, too large for one bucket, and strangers."""
    random.seed(7)
    centre, fps = random.getrandbits(62), set()
    for _ in range(150):
        fps.add(centre ^ sum(1 << b for b in random.sample(range(63), random.choice([0, 1, 2, 3, 5, 6]))))
    fps |= {random.getrandbits(62) for _ in range(200)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in components(near_links(df, crowd=crowd)).collect()}
    want = classes(fps)
    assert {f: got.get(f, f) for f in fps} == want
    if crowd > 2:
        got = {r.node: r.component for r in components(ball_links(df, 2)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_a_bucket_gives_no_row_for_a_pair(spark):
    """All of a family are close: 1,830 pairs, but each bucket links a fingerprint once."""
    fps = [0] + [1 << b for b in range(60)]
    links = near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert links.count() <= 2 * len(fps)
    got = {r.node: r.component for r in components(links).collect()}
    assert got == dict.fromkeys(fps, 0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(text, n):
    out = list(text)
    for _ in range(n):
        at, how = random.randrange(len(out) + 1), random.random()
        if how < 0.33 and at < len(out):
            out[at] = random.choice("abé")
        elif how < 0.66 and at < len(out):
            del out[at]
        else:
            out.insert(at, random.choice("abé"))
    return "".join(out)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    random.seed(threshold)
    texts = ["".join(random.choice("abé") for _ in range(random.randrange(14))) for _ in range(400)]
    pairs = [(t, changed(t, random.randrange(6))) for t in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("d", ld.banded_distance(F.col("a"), F.col("b"), threshold)).collect():
        d = edits(r.a, r.b)
        assert r.d == d if d <= threshold else r.d > threshold


@pytest.mark.parametrize(("threshold", "crowd"), [(1, 50), (1, 2), (2, 50)])
def test_near_lines(spark, threshold, crowd):
    random.seed(3)
    base = ["".join(random.choice("abé") for _ in range(random.randrange(4, 12))) for _ in range(50)]
    lines = sorted({changed(t, random.randrange(3)) for t in base for _ in range(4)} - {""})
    sets = Sets(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if edits(a, lines[j]) <= threshold:
                sets.join(i, j)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    got = {r.node: r.component for r in components(ld.near_lines(df, threshold, crowd)).collect()}
    assert all(got.get(i, i) == sets.find(i) for i in range(len(lines)))


def plain_lines(rows, least=32):
    """Text left by id, with lines within one edit of an earlier one dropped."""
    places = [
        (i, n, line.strip(" ")) for i, t in rows if i is not None for n, line in enumerate((t or "").split("\n"))
        if len(line.strip(" ")) >= least
    ]
    texts = sorted({p[2] for p in places})
    sets, by_size = Sets(texts), defaultdict(list)
    for t in texts:
        by_size[len(t), t[: len(t) // 2]].append(t)
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and (a[:14] == b[:14] or a[-14:] == b[-14:]) and edits(a, b) <= 1:
                sets.join(a, b)
    first = {}
    for i, n, t in sorted(places):
        first.setdefault(sets.find(t), (i, n))
    drop = {(i, n) for i, n, t in places if first[sets.find(t)] != (i, n)}
    return {
        i: t if not any(d[0] == i for d in drop) else "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in drop)
        for i, t in rows
    }


def test_counts_of_characters_prune_a_family(spark):
    """Of lines that share a key, those within three edits meet and next to no others: before, all 11,175 pairs did."""
    random.seed(5)
    words = ["".join(random.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    lines = []
    for _ in range(100):
        own = words[:20]
        for at in random.sample(range(4, 20), 6):
            own[at] = random.choice(words)
        lines.append(" ".join(own))
    lines += [changed(line, 3) for line in lines[:50]]
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    counted = ld.with_counts(df).withColumn("chars", F.length("line")).withColumn("key", F.lit(1))
    pairs = {(r.a, r.b) for r in ld._pairs(counted, 3).collect()}
    keys = {r.lid: set(r.k) for r in counted.select("lid", ld.count_keys(F.col("key"), 6).alias("k")).collect()}
    assert all((i, 100 + i) in pairs and keys[i] & keys[100 + i] for i in range(50))
    assert len(pairs) < 500


def test_counts_of_characters_are_sql(spark):
    """Counts modulo 8 around the circle, of any script, and without Python on the executors."""
    random.seed(2)
    lines = ["".join(random.choices("abcxyz 019.,ABÉéß漢😀", k=random.randrange(1, 300))) for _ in range(200)] + ["a" * 70_000]
    counted = ld.with_counts(spark.createDataFrame(list(enumerate(lines)), "lid long, line string"))
    for r in counted.collect():
        counts = [0] * 30
        for c in r.line:
            counts[ord(c) % 30] += 1
        circle = [[0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000][n & 7] for n in counts]
        assert [r.c1, r.c2] == [sum(x << (4 * i) for i, x in enumerate(circle[at : at + 15])) for at in (0, 15)]
    assert "MapInArrow" not in counted._jdf.queryExecution().toString()


def test_a_crowd_of_near_copies_gives_no_join_row_for_each_key(spark, monkeypatch):
    """Keys of crowded chunks are counted and taken out; before, a join gave each of them its size."""
    random.seed(9)
    rows, plain = {}, ld.written

    def counted(df, name):
        out = plain(df, name)
        rows[name] = out.count()
        if name != "fine-keys":
            rows["largest"] = max(rows.get("largest", 0), rows[name])
        return out

    monkeypatch.setattr(ld, "written", counted)
    family = "".join(random.choices("abcdefghij", k=300))
    lines = sorted({changed(family, random.randrange(1, 3)) for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    got = {r.node: r.component for r in components(ld.near_by_length(df, crowd=10)).collect()}
    assert [got.get(i, i) for i in range(len(lines))] == [0] * len(lines)
    assert rows["largest"] < rows["fine-keys"] / 2


def test_line_dedup(spark):
    line = "a line that is long enough to count here"
    rows = [
        (1, f"{line}\nshort\n\n{line}!"), (2, f"short\n {line} \nanother line that is also long enough"), (3, None), (4, ""),
        (5, line.replace("long", "lung")), (6, f"{line}?!"), (None, line), (7, "é" * 40 + "\n" + "é" * 39 + "e"),
    ]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_lines int")
    got = ld.line_dedup(docs).collect()
    assert {r.doc_id: r.text for r in got} == plain_lines(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_dropped == 1 and by_id[1].n_lines == 4 and by_id[None].n_dropped == 0
    assert ld.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.text for r in ld.line_dedup(docs).collect()} == plain_lines(rows)


def test_line_dedup_drops_short_copies(spark, tmp_path):
    """The registered query and the stage, at any length; short lines one edit apart stay."""
    rows = [(1, "ab\n\nab\nac\n  "), (2, " ab \nx"), (3, "ab\n\nx"), (4, "x"), (None, "ab")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {1: ("ab\n\nac\n  ", 1), 2: ("x", 1), 3: ("", 2), 4: ("", 1), None: ("ab", 0)}
    got = {r.doc_id: r for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r.text_sha256, r.n_dropped) for i, r in got.items()} == {
        i: (hashlib.sha256(t.encode()).hexdigest(), n) for i, (t, n) in want.items()
    }
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert left == {i: t for i, (t, _) in want.items() if t}


@pytest.mark.parametrize("crowd", [50, 2])
def test_near_by_length(spark, crowd):
    """Near copies, and families that differ in a few places only, over the bounds of bands."""
    random.seed(11)
    text = lambda n: "".join(random.choice("abcdeé") for _ in range(n))
    base = [text(random.choice([30, 32, 38, 39, 40, 42, 57, 59, 60, 62, 89, 91, 136, 240, 330])) for _ in range(30)]
    family = text(70)
    base += [family[:-8] + text(8) for _ in range(12)] + [text(300)[:30] + family * 4 + text(6) for _ in range(6)]
    lines = sorted({changed(t, random.randrange(5)) for t in base for _ in range(5)} | {"ab" * 40, "ab" * 41, "a" * 80, "a" * 83})
    sets = Sets(range(len(lines)))
    allowed = lambda n: (n >= 32) + (n >= 40) + (n >= 60)
    for i, a in enumerate(lines):
        for j in range(i):
            most = allowed(min(len(a), len(lines[j])))
            if most and abs(len(a) - len(lines[j])) <= most and edits(a, lines[j]) <= most:
                sets.join(i, j)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    got = {r.node: r.component for r in components(ld.near_by_length(df, crowd=crowd)).collect()}
    assert len({sets.find(i) for i in range(len(lines))}) < len(lines)
    assert all(got.get(i, i) == sets.find(i) for i in range(len(lines)))


def test_line_dedup_edits_grow_with_length(spark, tmp_path):
    """The registered query: one edit for each 20 characters, up to 3."""
    words = "The quick brown fox jumps over the lazy dog while seven wizards brew a pot of tea"
    pair = lambda n, k: f"{words[:n]}\n{'#' * k}{words[k:n]}"
    cases = [(35, 1, 1), (35, 2, 0), (45, 2, 1), (45, 3, 0), (80, 3, 1), (80, 4, 0)]
    rows = [(i, "\n".join(chr(65 + i) * 30 + x for x in pair(n - 30, k).split("\n"))) for i, (n, k, _) in enumerate(cases)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_dropped for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


@pytest.mark.parametrize("longest", [2000, 0])
def test_lines_with_a_running_number(spark, monkeypatch, longest):
    """A template with numbers crowds every chunk: all its lines are linked, with or without the links by deletions."""
    monkeypatch.setattr(ld, "DELETION_CHARS", longest)
    lines = [f"Chapter {i // 3} of the long report on the state of the river banks, page {i} of its second volume" for i in range(60)]
    lines += [x.replace("river banks", "harbour walls and sea gates") for x in lines]
    sets = Sets(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if abs(len(a) - len(lines[j])) <= 3 and edits(a, lines[j]) <= 3:
                sets.join(i, j)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    got = {r.node: r.component for r in components(ld.near_by_length(df, crowd=10)).collect()}
    assert [got.get(i, i) for i in range(len(lines))] == [sets.find(i) for i in range(len(lines))]


def test_blocks_grow_with_the_rows():
    from tessera.llm.simhash import blocks_for

    assert [blocks_for(n, 4) for n in (10, 1 << 27, 1 << 28, 1 << 34)] == [7, 7, 8, 9]
