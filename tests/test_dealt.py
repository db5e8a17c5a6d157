"""Tasks of a join stay small, however large the tables are."""

from pyspark.sql import functions as F

from notelake.operators import skew
from notelake.plans.registry import QUERIES


def test_a_table_is_dealt_by_its_rows(spark):
    rows = spark.range(1_000)
    dealt = skew.dealt(rows, "id", 50)
    assert dealt.rdd.getNumPartitions() == 20
    assert max(len(p) for p in dealt.rdd.glom().collect()) < 100
    assert skew.dealt(rows, "id", 400) is rows


def test_the_joins_of_a_peer_fetch_follow_the_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(600).selectExpr("id as o_orderkey", "id % 37 as o_custkey", "substring('OFP', cast(id % 3 as int) + 1, 1) as o_orderstatus", "1.0 as o_totalprice", "timestamp_ntz '1998-01-01 00:00:00' as o_orderdate", "'1-URGENT' as o_orderpriority")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = QUERIES["peer_fetch"](spark, str(tmp_path)).collect()
        monkeypatch.setattr(skew, "DEALT", 20)
        df = QUERIES["peer_fetch"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert want and sorted(tuple(r)[:-1] for r in got) == sorted(map(tuple, want))
    assert len({r.task for r in got}) > 10
