"""Secret, license and URL scans against plain Python on whole small tables and on edge cases."""

import hashlib
import random
import re

import pytest

from tessera.llm import licenses, secrets, url_filter
from tessera.llm.licenses import license_scan
from tessera.llm.secrets import secret_report
from tessera.llm.url_filter import RULES, url_verdicts

SF = "/root/testdata/sf0.01"
SPACED = 'say token token=abcdef, secret=token: "abcdefgh" é AKIA' + "Q7" * 9 + " " + "0a1b2c3d" * 4
RANDOM = "key9Zx7Qp2Lm5Vt8Rb3Nc6Wd1 and 123e4567-e89b-12d3-a456-426614174000 and your_key_Zx7Qp2Lm5Vt8Rb3N"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, 0), (2, "", 0), (3, " \n\t ", 0), (4, SPACED, 0), (4, SPACED, 0), (None, SPACED, 0), (5, RANDOM, 1),
        (6, "x " * 30_000 + "password = hunter22 under THE mit-license", 2), (7, "apache license version 2 " * 3, 0),
        (8, "Licensed under CC BY-NC 4.0 and CC BY NC", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, base int")


def plain_secrets(text):
    text, found = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def check_secrets(docs):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    got = secret_report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = plain_secrets(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[3] == k for w in want) for k in ("assign", "access", "hex"))
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_secrets_on_documents(spark):
    check_secrets(spark.read.parquet(f"{SF}/documents.parquet"))


def test_secrets_on_odd_rows(odd):
    check_secrets(odd)
    by_id = {r.doc_id: r for r in secret_report(odd).collect()}
    assert by_id[5].n_entropy == 1  # the UUID and the placeholder are on the allow list
    assert by_id[1].spans == by_id[2].spans == ""


def test_window_entropy(spark):
    from math import log2

    from pyspark.sql import functions as F

    words = ["aB3" * 12, "abcdefghijklmnopqrstuvwxyz0123", "a" * 40, "short", "Zx7Qp2Lm5Vt8Rb3Nc6Wd1Zx7Qp2Lm5Vt"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.window_entropy(F.col("w")).alias("h"))
    for r in got.collect():
        parts = [r.w[i : i + 20] for i in range(len(r.w) - 19)]
        want = max((-sum(p.count(c) / 20 * log2(p.count(c) / 20) for c in set(p)) for p in parts), default=0)
        assert r.h == pytest.approx(want, abs=1e-9)


def plain_licenses(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_licenses(spark, odd, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = license_scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.n_base == 0
            continue
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_license_span_with_gap(spark):
    text = "redistribution and use in source and binary forms with or without any modification are permitted"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = license_scan(docs).first()  # the inserted word shifts the diagonal by one and costs two 3-grams of 12
    assert row.labels == "bsd" and row.score == pytest.approx(10 / 12)
    assert license_scan(docs, gap=0).first().labels == ""


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    odd = [None, "", "no url", "http://COM", "http://A.com/x?y#z", "://net/es/", "http://x.net/es", "http://www.example.com/en/\n"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(odd, 1)], "page_id long, url string"))
    urls = {r.page_id: r.url for r in pages.collect()}
    got = url_verdicts(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in url_verdicts(pages).collect()} == {"allow"}
    assert url_verdicts(pages.limit(0)).count() == 0


def test_suffix_counts_cover_all_pages(spark, monkeypatch):
    """A suffix that no rule touches counts by all its pages, and the sample doesn't change that."""
    monkeypatch.setattr(url_filter, "FEATURES", ("suffix_count",))
    hosts = ["a.com"] * 200 + ["a.net"] * 10 + ["a.org"] * 200
    pages = spark.createDataFrame([(i, f"http://{h}/es/{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {(r.host, r.verdict) for r in url_verdicts(pages).collect()}
    assert got == {("a.com", "allow"), ("a.net", "block"), ("a.org", "allow")}  # org is as common as com
    assert got == {(r.host, r.verdict) for r in url_verdicts(pages, sample=150).collect()}


def test_secrets_in_very_long_tokens_and_many_spans(spark):
    """No pattern overflows the stack, and the work grows with the text, not with its square."""
    texts = ["a1/" * 30_000, "Ab1" * 30_000 + "/", "a" * 100_000 + "1", " ".join(f"token=Zx7Qp2Lm5Vt8Rb3Nc6W{i:05d}" for i in range(20_000))]
    texts.append(" ".join(f"Zx7Qp2Lm5Vt8Rb3Nc6W{i:05d}" for i in range(20_000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_assign, r.n_entropy) for r in secret_report(docs).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (20_000, 0), 4: (0, 20_000)}
    assert secret_report(docs.limit(0)).count() == 0


def test_running_sums(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.array(*[F.lit(i % 7) for i in range(300)]).alias("a"))
    want = [sum(i % 7 for i in range(n + 1)) for n in range(300)]
    assert df.select(secrets.running_sums(F.col("a"), 16).alias("s")).first().s == want
    assert df.select(secrets.running_sums(F.slice("a", 1, 0)).alias("s")).first().s == []


def changed_words(words, n):
    """``n`` words replaced, dropped or inserted, apart from each other."""
    out = list(words)
    for at in sorted(random.sample(range(2, len(out) - 2, 4), n), reverse=True):
        how = random.random()
        out[at : at + 1] = ["other"] if how < 0.34 else [] if how < 0.67 else [out[at], "other"]
    return out


def test_license_recall_on_changed_texts_and_order(spark):
    """One change in each started twenty words; the same words in another order and short phrases give no label."""
    random.seed(6)
    rows, shuffled = [], []
    for text, label in licenses.TEMPLATES:
        words = text.split()
        for _ in range(20):
            rows.append((label, " ".join(["before"] * 3 + changed_words(words, 1 + (len(words) - 1) // 20) + ["after"] * 3)))
        shuffled.append(" ".join(words[i : i + 4][j] for i in range(len(words) - 4, -1, -4) for j in range(4)))
    rows += [("", t) for t in shuffled]
    rows += [("", "they said all rights reserved seats were gone"), ("", "the terms of the gnu are not in this text"), ("", "without warranty of any kind")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan(docs).collect()}
    planted = [i for i, (label, _) in enumerate(rows) if label]
    recall, alone = (sum(f(rows[i][0], got[i]) for i in planted) / len(planted) for f in (lambda x, g: x in g.split(","), str.__eq__))
    print(recall, alone)
    assert recall >= 0.85 and alone >= 0.75  # what is missed has changes within two words of an end, or in a short notice
    assert [(t, got[i]) for i, (label, t) in enumerate(rows) if not label and got[i] and "apache license version 2" not in t] == []


def test_license_rows_with_one_id_or_none(spark):
    rows = [(None, "under the mit license"), (1, "under the MIT license"), (1, "nothing"), (None, None)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, row int")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.labels) for r in license_scan(docs).collect()), key=str)
    assert got == [(1, 1, 0, ""), (1, 4, 1, "mit"), (None, 0, 0, ""), (None, 4, 1, "mit")]
    assert license_scan(docs.limit(0)).count() == 0


def test_url_trees_decide(spark):
    """Held-out URLs, with and without their suffix, against always saying the more frequent verdict; both verdicts occur."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    for suffixes in (True, False):
        got = url_verdicts(pages, suffixes=suffixes).collect()
        held = [(r.verdict, r.block_score > 0.5) for r in got if r.held_out and r.rule]
        right = sum((v == "block") == b for v, b in held) / len(held)
        blocked = sum(v == "block" for v, _ in held) / len(held)
        undecided = [r.verdict for r in got if r.rule is None]
        print(suffixes, len(held), right, max(blocked, 1 - blocked), {v: undecided.count(v) for v in set(undecided)})
        assert right > max(blocked, 1 - blocked) + 0.05
        assert set(undecided) == {"allow", "block"}


def plain_entropy(text):
    from math import log2

    return -sum(text.count(c) / len(text) * log2(text.count(c) / len(text)) for c in set(text)) if text else 0.0


def test_url_features(spark):
    urls = ["", "http://a.com", "https://www.b-c.d.org/x/y.html?a=1&b=22#z", "http://h/" + "p9/" * 2000]
    df = url_filter.lexical(url_filter.url_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")))
    for r in df.collect():
        host, path, *_ = plain_rule(r.url)
        query = re.search(r"\?([^#]*)", r.url)
        assert (r.length, r.host_length, r.labels, r.depth) == (len(r.url), len(host), host.count("."), path.count("/"))
        assert r.digit_ratio == pytest.approx(sum(c in "0123456789" for c in r.url) / max(len(r.url), 1))
        assert r.entropy == pytest.approx(plain_entropy(r.url))
        assert r.parameters == (query[1].count("&") + 1 if query and query[1] else 0)
        assert (r.hyphens, r.secure) == (r.url.count("-"), float(r.url.startswith("https:")))


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(i, f"http://a.{t}/es/{i}", "x", 1) for i in range(60) for t in ("com", "net")], "page_id long, url string, suffix string, label int")
    assert url_verdicts(pages).count() == 120
