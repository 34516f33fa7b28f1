"""Every query with an SQL form gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from sparkwell.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def _rows(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or v is np.nan or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v

    key = lambda r: tuple((x is None, str(x)) for x in r)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=key)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-5 + 2e-6 * max(abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = _rows(catalogue.QUERIES[name](spark, FOLDER).toPandas())
    want = _rows(duck.execute(catalogue.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    if got[1] != want[1]:
        for a, b in zip(got[1], want[1], strict=True):
            assert all(_close(x, y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
