"""Ties between rows of large numbers: a query and its SQL both take the highest score, then the least number."""

import duckdb
import pytest
from pyspark.sql import functions as F

from notelake.plans.registry import ORACLES, QUERIES

BIG = 10**9


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Examples and photos whose numbers lie further apart than their scores do."""
    path = str(tmp_path_factory.mktemp("ties"))
    vectors = [(2, 0, [0.5, 0.5]), (BIG, 0, [0.500002, 0.5]), (BIG + 2, 0, [0.500002, 0.5]), (4, 1, [0.6, 0.3]), (BIG + 4, 1, [0.600002, 0.3]), (1, 0, [1.0, 0.0]), (3, 1, [1.0, 0.0]), (11, 0, [0.0, 0.1])]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    events = [(5, 1, 10.0), (BIG, 1, 10.01), (BIG + 1, 1, 10.01), (6, 2, 7.0), (BIG + 2, 2, 7.0)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").withColumns({"event_type": F.lit("view"), "ts": F.lit("2000-01-01").cast("timestamp_ntz"), "props": F.lit("{}")}).coalesce(1).write.parquet(f"{path}/events.parquet")
    orders = spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey long, o_custkey long").withColumns({"o_orderstatus": F.lit("O"), "o_totalprice": F.lit(1.0), "o_orderdate": F.lit("2000-01-01").cast("timestamp_ntz"), "o_orderpriority": F.lit("1-URGENT")})
    orders.coalesce(1).write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["recall_override", "follow_learned", "learn_override", "image_signal"])
def test_the_least_number_of_the_best(spark, folder, name):
    df, con = QUERIES[name](spark, folder), duckdb.connect()
    for table in ("embeddings", "events", "orders"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    rel = con.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(map(tuple, df.collect()))
    assert got and got == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
