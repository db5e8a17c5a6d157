"""Answers on a few notes: two versions back, and a row for every question."""

import duckdb
import pytest
from pyspark.sql import functions as F

from notelake.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Question 0 is like note 8, whose versions go back to 5, and like 12, which has no asset and goes back to 10; nothing is like question 50."""
    path = str(tmp_path_factory.mktemp("answers"))
    vectors = {0: [1.0, 0.0, 0.0], 8: [1.0, 0.1, 0.0], 12: [1.0, 0.2, 0.0], 50: [0.0, 0.0, 1.0]}
    texts = {0: "pump seal leaks oil", 8: "pump seal leaks oil again", 12: "pump seal leaks", 50: "holiday"}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    events = spark.createDataFrame([(900, 900, 1.0)], "event_id long, user_id long, value double").withColumns({"event_type": F.lit("view"), "ts": F.lit("2000-01-01").cast("timestamp_ntz"), "props": F.lit("{}")})
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    orders = spark.range(60).select(F.col("id").alias("o_orderkey"), (F.col("id") + 100).alias("o_custkey")).withColumns({"o_orderstatus": F.lit("O"), "o_totalprice": F.lit(1.0), "o_orderdate": F.lit("2001-08-01").cast("timestamp_ntz"), "o_orderpriority": F.lit("1-URGENT")})
    orders.coalesce(1).write.parquet(f"{path}/orders.parquet")
    return path


def test_points_go_two_versions_back_and_every_question_has_a_row(spark, folder):
    df, con = QUERIES["answer_compose"](spark, folder), duckdb.connect()
    got = {r.query_id: r for r in df.collect()}
    note = {r.memory_id: r.text for r in spark.read.parquet(f"{folder}/orders.parquet").selectExpr("o_orderkey as memory_id", "concat('Pump P-', o_custkey % 100, ' 1-urgent reading ', o_orderkey % 50, if(o_orderkey % 8 = 0, ' bearing replaced, normal', ' vibration high')) as text").collect()}
    assert set(got) == {0, 50}
    assert got[0].points == f"8 < 7 {note[7]} < 6 {note[6]}\n12 < 11 {note[11]} < 10 {note[10]}"
    assert got[0].answer == f'P-8: {note[8]} This resolves an earlier note: "{note[7]}"\n{note[12]} This resolves an earlier note: "{note[11]}"'
    assert (got[50].answer, got[50].points) == ("Nothing in this device's memory matches that yet.", "")
    for table in ("embeddings", "documents", "events", "orders"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    rel = con.sql(ORACLES["answer_compose"])
    assert sorted(tuple(r[rel.columns.index(c)] for c in df.columns) for r in rel.fetchall()) == sorted(map(tuple, got.values()))
