"""Every registered query of the record operators against its SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tessera.plans import queries

SF = os.environ.get("TESSERA_SF_DIR", "/root/testdata/sf0.001")


def _plain(value):
    if value is None or isinstance(value, str | bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", list(queries.queries()))
def test_matches_sql(spark, oracle, name):
    got = queries.queries()[name](spark, SF)
    cursor = oracle.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(_plain(v) for v in row) for row in cursor.fetchall()), key=key)
    rows = sorted((tuple(_plain(row[n]) for n in names) for row in got.collect()), key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == pytest.approx(b) if not any(isinstance(x, str) or x is None for x in (*a, *b)) else a == b
