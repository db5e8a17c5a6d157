"""The vector index against all pairs."""

import os

import numpy as np
import pytest

from notelake.operators import retrieval, vector_index
from notelake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def made(spark, n=1500, seed=1):
    """Clusters, one of which has a third of all rows as copies; odd rows."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(30, 12))
    x = centres[rnd.integers(30, size=n)] + 0.25 * rnd.normal(size=(n, 12))
    x[: n // 3] = centres[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(None, [1.0] * 12), (n, None), (n + 1, [1.0, 2.0])]
    return spark.createDataFrame(rows, SCHEMA)


def test_few_lists_find_the_true_neighbours(spark):
    df = made(spark).cache()
    queries = df.where("vec_id % 13 = 0")
    index = vector_index.build(df)
    assert index.rows.count() == 1500 and len(index.centroids) == 38
    exact = retrieval.cosine_topk(queries, df, 5).cache()
    probes = vector_index.probes_for(index, queries, 5)
    assert probes <= len(index.centroids) // 3
    assert vector_index.recall(vector_index.search(index, queries, 5, probes), exact) >= 0.9
    # All lists give the answer of all rows, ties included.
    whole = vector_index.search(index, queries, 5, len(index.centroids))
    key = lambda d: sorted((r.query_id, r.vec_id, r.score, r.place) for r in d.collect())
    assert key(whole) == key(exact)


def test_empty_and_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    assert vector_index.search(vector_index.build(none), one, 3, 1).collect() == []
    got = vector_index.search(vector_index.build(one, 5), one, 3, 9).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(1, 2, 0.0), (2, 1, 0.0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_recall_on_the_given_vectors(spark):
    exact = QUERIES["dense_topk"](spark, SF).cache()
    assert vector_index.recall(QUERIES["dense_index"](spark, SF), exact) >= 0.9
