import random

import duckdb
import numpy as np

from notelake.llm import dart_minhash as d
from notelake.llm.shingles import mix
from tests.llm.conftest import rows, words


def test_agreement_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(3)
    for share, n in ((0.9, 40), (0.5, 400)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: int(share * n)], rng.integers(0, 2**63, n - int(share * n)).astype(np.uint64)])
        weigh = lambda x: 0.5 + (mix(x) % np.uint64(700)).astype(float) / 100
        both = weigh(np.intersect1d(a, b)).sum()
        true = both / (weigh(a).sum() + weigh(b).sum() - both)
        sig = d.dart_signatures(np.concatenate([a, b]), np.concatenate([weigh(a), weigh(b)]), np.repeat([0, 1], n), 2, 4000)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.035
        assert np.isfinite(sig).all()


def brute(documents):
    sets = []
    for _, text in documents:
        w = (text or "").lower().encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                label[root(i)] = root(j)
    out = []
    for i in range(len(sets)):
        own = [documents[j][0] for j in range(len(sets)) if root(j) == root(i)]
        out.append((documents[i][0], min([x for x in own if x is not None], default=None), len(own)))
    return sorted(out, key=str)


def cloud():
    """Near copies of one text with random edits, chains of edits, exact copies and unrelated texts."""
    rng, out, base = random.Random(4), [], words(120).split()
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**9)}"
        out.append((i, " ".join(w)))
    chain = words(100, 9).split()
    for i in range(12):
        chain[i * 8] = f"step{i}"
        out.append((300 + i, " ".join(chain)))
    return out + [(400 + i, out[i % 7][1]) for i in range(30)] + [(500 + i, words(50, 20 + i)) for i in range(40)]


def test_classes_equal_brute_force(spark):
    documents = cloud()
    random.Random(1).shuffle(documents)
    got = d.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == brute(documents)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_odd_inputs(spark, docs, empty):
    got = d.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == brute([(r[0], r[1]) for r in rows()])
    kept = d.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 4, 5, 6, 7, 8, 9} <= set(ids) and not {2, 3} & set(ids) and ids.count(None) == 1 and ids.count(8) == 2
    assert d.near_duplicates(empty).count() == 0
    assert d.keep_one(empty).count() == 0


def test_sql_agrees(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = con.sql(d.sql()).fetchall()
    got = [tuple(r) for r in d.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pairs_that_differ_in_a_very_long_token_are_found(spark):
    """Their plain similarity is over 0.8, however long the token is."""
    documents = []
    for i in range(60):
        w = words(50, 1000 + i).split()
        documents += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:25], "x" * 20_000, *w[26:]]))]
    got = {r.doc_id: r.class_size for r in d.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string")).collect()}
    assert got == {i: 2 for i in range(120)}


def test_bands_fit_the_worst_weights():
    w = d.weights(np.array([0.0, 1, 30, 10**6]))
    assert w.max() <= w.min() * (1 + d.SPREAD) + 1e-12
    worst = d.THRESHOLD / (d.THRESHOLD + (1 - d.THRESHOLD) * (1 + d.SPREAD))
    assert (1 - worst**d.ROWS) ** d.BANDS < 2e-6


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_recall_of_near_copies(spark):
    """Planted pairs of similarity 0.8 to 0.95: nearly all are found, and none below 0.8 is linked."""
    rng, documents, true = random.Random(8), [], []
    for i in range(600):
        w = words(rng.randint(60, 400), 5000 + i).split()
        v = list(w)
        goal = rng.uniform(0.76, 0.95)
        while similarity(w, v) > goal:
            v[rng.randrange(len(v))] = f"new{rng.randrange(10**9)}"
        documents += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        true.append(similarity(w, v) >= 0.8)
    got = {r.doc_id: r.class_size for r in d.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string")).collect()}
    found = [got[2 * i] == 2 for i in range(600)]
    assert sum(f for f, t in zip(found, true, strict=True) if t) >= 0.99 * sum(true) > 200
    assert not any(f for f, t in zip(found, true, strict=True) if not t)


def test_crowded_buckets_and_hot_classes(spark, monkeypatch):
    """Blocks of a bucket and hot keys give what all pairs give."""
    from notelake.operators import skew

    monkeypatch.setattr(d, "BLOCK", 7)
    monkeypatch.setattr(skew.join_counted, "__defaults__", (5, skew.MAX_HOT))
    documents = cloud() + [(900 + i, words(50, 20)) for i in range(40)]
    got = d.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == brute(documents)
