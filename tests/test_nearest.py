"""Vector searches against all pairs: ties, nulls, widths, hot groups, slices; prototypes of many labels."""

import numpy as np
import pytest

from notelake.operators import policy, retrieval

SCHEMA = "vec_id long, label string, embedding array<double>"


def made(n=240, seed=0):
    """Few different vectors, so that many scores tie; one label has most rows."""
    rnd = np.random.default_rng(seed)
    base = np.round(rnd.normal(size=(40, 4)), 2)
    rows = [(i, "hot" if rnd.random() < 0.7 else f"l{rnd.integers(5)}", [float(x) for x in base[rnd.integers(40)]]) for i in range(n)]
    return rows + [(None, "hot", rows[0][2]), (9001, None, rows[0][2]), (9002, "hot", None), (9003, "hot", [1.0, 2.0])]


def brute(queries, corpus, k, least=-1e9, same=None):
    out = []
    for q, ql, qv in queries:
        hits = [(-round(float(np.dot(qv, v)), 6), i) for i, la, v in corpus if i is not None and v is not None and len(v) == len(qv) and i != q and (not same or la is not None and la == ql)]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(hits)[:k]) if -s >= least]
    return sorted(out)


def whole(rows):
    return [r for r in rows if r[0] is not None and r[2] is not None and len(r[2]) == 4]


@pytest.mark.parametrize(("scores", "block"), [(1 << 21, 1 << 20), (300, 60)])
def test_cosine_topk(spark, monkeypatch, scores, block):
    monkeypatch.setattr(retrieval, "SCORES", scores)
    rows = made()
    queries = [r for r in rows if r[0] is None or r[0] % 7 == 0]
    got = retrieval.cosine_topk(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA), 5, block=block)
    assert sorted((r.query_id, r.vec_id, r.score, r.place) for r in got.collect()) == brute(whole(queries), rows, 5)


def test_top_in_slices(monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES", 50)
    rows = whole(made(400, 3))
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    top = retrieval._Top(ids[:20], vectors[:20], 6)
    for lo in range(0, 400, 37):
        top.add(ids[lo : lo + 37], vectors[lo : lo + 37])
    query, vec, score = top.rows()
    assert sorted(zip(query.tolist(), vec.tolist(), score.tolist(), strict=True)) == sorted(x[:3] for x in brute(rows[:20], rows, 6))


@pytest.mark.parametrize("block", [2000, 17])
def test_nearest_within(spark, block):
    rows = made(seed=5)
    queries = [r for r in rows if r[0] is None or r[0] % 3 == 0]
    got = retrieval.nearest_within(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(rows, SCHEMA), "label", 2, 0.5, block=block)
    assert sorted((r.query_id, r.vec_id, r.score, r.place) for r in got.collect()) == brute([q for q in whole(queries) if q[1]], rows, 2, 0.5, True)
    assert retrieval.nearest_within(spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA), "label", 2).collect() == []


def test_prototypes_of_more_labels_than_are_sent_at_once(spark):
    rows = [(i, i % 23, r[2]) for i, r in enumerate(whole(made(seed=6)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    one, many = (policy.prototypes(df, 3, n) for n in (2000, 4))
    assert one.count() == 1 < many.count()
    scores = lambda protos: {r.vec_id: sorted((s.label, s.score) for s in r.scores) for r in policy.category_scores(df, protos).collect()}
    got = scores(many)
    assert got == scores(one) and len(got) == len(rows)
    first = {label: [v for _, la, v in rows if la == label][:3] for label in range(23)}
    for i, _, v in rows[:20]:
        cos = {label: [float(np.dot(v, w)) for w in vs] for label, vs in first.items()}
        assert all(abs(s - (0.7 * max(cos[label]) + 0.3 * np.mean(cos[label]))) < 1e-6 for label, s in got[i])
