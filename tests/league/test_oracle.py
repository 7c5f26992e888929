"""Every registered league query that SQL can express, against DuckDB on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

from ringlore.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def test_every_query_has_sql_or_is_iterative():
    assert set(QUERIES) - set(ORACLE_SQL) == {"mdl01_elo", "mdl13_irls", "mdl27_style_map", "dq09_core", "dq13_components", "mdl17_impact", "mdl16_finish", "lnk03_draws", "srch06"}


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query(spark, duck, key):
    got = QUERIES[key](spark, SF)
    want = duck.sql(ORACLE_SQL[key])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4) for p, q in zip(x, y)), (x, y)
