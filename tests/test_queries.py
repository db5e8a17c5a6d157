"""Every registered query against its DuckDB twin, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from notelake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert got == sorted(str(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
