"""Registered queries of the training-data operators against their SQL, on the tables and on planted rows."""

import random
import string

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.01"
B64 = string.ascii_letters + string.digits + "+/"


def planted_texts(n=300):
    """Texts with a random value of each class that no fixed pattern finds, and texts with values that are none."""
    random.seed(8)
    pick = lambda chars, k: "".join(random.choice(chars) for _ in range(k))
    word = lambda: pick(string.ascii_lowercase, random.randrange(2, 9))
    kinds = {
        "upper_hex": lambda: pick("0123456789ABCDEF", 40),
        "one_case": lambda: pick(string.ascii_lowercase + string.digits, 32),
        "base64": lambda: pick(B64, 40),
        "url_safe": lambda: pick(string.ascii_letters + string.digits + "-_", 36),
    }
    plain = {
        "path": lambda: "/".join(word() for _ in range(6)),
        "joined": lambda: "-".join(word() for _ in range(7)),
        "snake": lambda: "_".join(word() for _ in range(6)) + str(random.randrange(99)),
        "repeat": lambda: "Ab1" * random.randrange(7, 20),
        "uuid": lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        "word": lambda: pick(string.ascii_letters, 24),
        "number": lambda: pick(string.digits, 30),
    }
    return [(kind, f"the value {make()} stands here") for group in (kinds, plain) for kind, make in group.items() for _ in range(n)], set(kinds)


def test_planted_recall_and_false_alarms(spark):
    texts, secret = planted_texts()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in queries.secret_report(docs).collect():
        found.setdefault(texts[r.doc_id][0], []).append(r.n_entropy)
    share = {k: sum(x > 0 for x in v) / len(v) for k, v in found.items()}
    print(share)
    assert all(share[k] >= 0.9 for k in secret)
    assert all(share[k] <= 0.05 for k in share if k not in secret)


ODD_TEXTS = [
    None, "", " \n\t ", "a1/" * 300, "Ab1" * 400, 'token="abcdefgh" é Zx7Qp2Lm5Vt8Rb3Nc6Wd1Yk4', "x " * 3000 + "password = hunter22",
    "9233A8ECF7C5B09FE5949719B6B82BC439E9329B, 9233A8ECF7C5B09FE5949719B6B82BC439E9329B", " ".join(f"token=abc{i:06d}" for i in range(700)),
    "Licensed under the Apache License, Version 2.0. cc by nc CC BY-NC under the MIT License", "apache license version 2 " * 40,
]


def ordered(found):
    return sorted((tuple(row) for row in found), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
@pytest.mark.parametrize("table", ["whole", "odd", "empty"])
def test_matches_sql(spark, name, table, tmp_path):
    sf = SF
    if table != "whole":
        texts = ODD_TEXTS + [t for _, t in planted_texts(2)[0]] if table == "odd" else []
        made = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(i // 2, t) for i, t in enumerate(texts)]
        spark.createDataFrame(made, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        pages = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[3])] if table == "odd" else []
        spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
        sf = str(tmp_path)
    db = duckdb.connect()
    for each in ("documents", "pages"):
        path = f"{sf}/{each}.parquet" if table == "whole" else f"{sf}/{each}.parquet/*.parquet"
        db.execute(f"CREATE VIEW {each} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, sf)
    cursor = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = ordered([plain(v) for v in row] for row in cursor.fetchall())
    assert ordered([plain(r[n]) for n in names] for r in got.collect()) == want


URLS = [None, "", "no url", "http://COM", "http://A.com/x?y#z", "://net/es/", "http://x.net/es", "http://www.example.com/en/\n", "HTTP://É.Net/fr/x://y",
        "http://" + "a" * 30_000 + ".org/b/" + "c/" * 9000]
