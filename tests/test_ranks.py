from pyspark.sql import functions as F

from notelake.operators.ranks import ranked
from notelake.sources.scratch import materialize


def test_places_over_many_tasks(spark):
    rows = materialize(spark.range(5_000).selectExpr("(id * 7919) % 5000 as k", "id % 3 as g"), "rows")
    out, total = ranked(rows, F.col("g").desc(), F.col("k"))
    got = [(r.g, r.k, r["rank"]) for r in out.orderBy("rank").collect()]
    assert total == 5_000 and [g[:2] for g in got] == sorted((g[:2] for g in got), key=lambda x: (-x[0], x[1])) and [g[2] for g in got] == list(range(1, 5_001))


def test_equal_rows_are_shared_out(spark):
    rows = materialize(spark.range(20_000).selectExpr("cast(null as long) as k", "5L as score"), "equal")
    out, total = ranked(rows, F.col("score").desc())
    assert total == 20_000 and out.selectExpr("min(rank)", "max(rank)", "count(distinct rank)").first()[:] == (1, 20_000, 20_000)


def test_no_rows(spark):
    out, total = ranked(materialize(spark.range(0), "none"), F.col("id"))
    assert total == 0 and out.collect() == []
