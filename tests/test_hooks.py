import pandas as pd
import pytest
from pyspark.sql import functions as F

from notelake.operators import hooks
from notelake.sources import versions


def test_embed(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "memory_id long, text string")
    assert {r.memory_id: r.vector for r in hooks.embed(docs, "memory_id", lambda ts: [[float(len(t))] for t in ts]).collect()} == {1: [2.0], 2: [0.0]}


def test_add_names(spark):
    arr = lambda xs, kind=False: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), *([F.lit("phone").alias("kind")] if kind else [])) for a, b in xs))
    got = spark.range(1).select(hooks.add_names(arr([(5, 9)], True), arr([(0, 3), (8, 12), (9, 11)]))).first()[0]
    assert [(s["start"], s["end"], s["kind"]) for s in got] == [(0, 3, "person"), (5, 9, "phone")]  # touching names are one, which meets the phone


def test_rerank(spark):
    @F.pandas_udf("double")
    def scorer(query: pd.Series, text: pd.Series) -> pd.Series:
        return (query == text).astype(float)

    rows = spark.createDataFrame([(1, i, "q", "q" if i == 3 else "x", 1 - i / 10) for i in range(6)], "query_id long, memory_id long, query string, text string, score double")
    got = [r.memory_id for r in hooks.rerank(rows, scorer, head=4).orderBy("place").collect()]
    assert got == [3, 0, 1, 2, 4, 5]


def test_migrate(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 9)], "memory_id long, version int")
    steps = [lambda d: d.withColumn("memory_id", F.col("memory_id") * 10), lambda d: d.withColumn("memory_id", F.col("memory_id") + 1)]
    assert sorted((r.memory_id, r.version) for r in hooks.migrate(rows, steps).collect()) == [(3, 2), (3, 2), (11, 2)]


def test_versions(spark, tmp_path):
    root, schema = f"file://{tmp_path}/state", "k long, v string"
    assert versions.newest(spark, root) == 0
    versions.upsert(spark, root, spark.createDataFrame([(1, "a"), (2, "b")], schema), ["k"])
    versions.upsert(spark, root, spark.createDataFrame([(2, "c"), (3, "d")], schema), ["k"], spark.createDataFrame([(1,)], "k long"))
    assert sorted(map(tuple, versions.read(spark, root).collect())) == [(2, "c"), (3, "d")] and versions.newest(spark, root) == 2
    versions.write_lines(versions.read(spark, root), "v", ["k"], f"{root}-lines")
    assert [r.value for r in spark.read.text(f"{root}-lines").collect()] == ["c", "d"]


def test_two_writers_of_a_version(spark, tmp_path):
    root, schema = f"file://{tmp_path}/state", "k long, v string"
    row = lambda k, v: spark.createDataFrame([(k, v)], schema)
    versions.upsert(spark, root, row(0, "a"), ["k"])
    assert versions.write(row(1, "b"), root, base=1) == 2
    with pytest.raises(versions.Conflict):
        versions.write(row(2, "c"), root, base=1)
    assert [tuple(r) for r in versions.read(spark, root).collect()] == [(1, "b")]

    # Another writer commits between the read and the commit of an upsert: both rows are there in the end.
    first, late = versions.write, []

    def meddled(df, at, base=None):
        if not late:
            late.append(first(row(5, "other").unionByName(versions.read(spark, at)), at, base))
        return first(df, at, base)

    versions.write = meddled
    try:
        assert versions.upsert(spark, root, row(6, "mine"), ["k"]) == 4 and late == [3]
    finally:
        versions.write = first
    assert sorted(map(tuple, versions.read(spark, root).collect())) == [(1, "b"), (5, "other"), (6, "mine")]
    (tmp_path / "state" / "commits" / f"{5:010d}").touch()  # a writer that is about to commit
    assert versions.newest(spark, root) == 4


def test_chains_of_heads_and_repeated_keys(spark):
    from notelake.operators.chains import ancestors

    rows = [(1, None), (2, 1), (3, 2), (3, 2), (4, 9), (5, 6), (6, 5), (None, 3), (7, 3)]
    df = spark.createDataFrame(rows, "memory_id long, supersedes long")
    every = sorted(map(tuple, ancestors(df).collect()))
    assert every == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (5, 6, 1), (6, 5, 1), (6, 6, 0), (7, 1, 3), (7, 2, 2), (7, 3, 1), (7, 7, 0)]
    heads = spark.createDataFrame([(3,), (3,), (5,), (8,), (None,)], "memory_id long")
    assert sorted(map(tuple, ancestors(df, heads=heads).collect())) == [r for r in every if r[0] in (3, 5)]
