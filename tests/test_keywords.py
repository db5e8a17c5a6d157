"""The pruned keyword search against the score of every pair."""

import math
import random
from collections import Counter

import pytest

from notelake.operators import retrieval

DOCS = "doc_id long, text string, shard string, status string"


def made(n=220, seed=1):
    """Common words in nearly all texts, rarer ones in few, copies, empty and null texts."""
    rnd = random.Random(seed)
    common, rare = ["the", "of", "pump", "is"], [f"r{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(common, k=rnd.randint(3, 30)) + rnd.choices(rare, k=rnd.randint(0, 4))), rnd.choice("ab"), rnd.choice(["active", "gone"])) for i in range(n)]
    return rows + [(n, None, "a", "active"), (n + 1, "", "b", "active"), (n + 2, rows[0][1], rows[0][2], "active"), (n + 3, rows[0][1], rows[0][2], None)]


def brute(queries, docs, k, within=False, live=False, same=False):
    tf = {d[0]: Counter((d[1] or "").lower().split()) for d in docs}
    tf = {i: c for i, c in tf.items() if c}
    df, size = Counter(t for c in tf.values() for t in c), {i: sum(c.values()) for i, c in tf.items()}
    avg, out = sum(size.values()) / len(size), []
    for q, text in queries:
        scored = []
        for i, _, shard, status in docs:
            shared = set((text or "").lower().split()) & set(tf.get(i, ()))
            if shared and not (live and status != "active") and not (same and i == q):
                s = sum(math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * tf[i][t] * 2.2 / (tf[i][t] + 1.2 * (0.25 + 0.75 * size[i] / avg)) for t in sorted(shared))
                scored.append((shard if within else "", -round(s, 6), i))
        for shard in {s[0] for s in scored}:
            own = sorted(s[1:] for s in scored if s[0] == shard)
            out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(own[:k])]
    return sorted(out)


@pytest.mark.parametrize("sent", [200_000, 1])
def test_best_documents(spark, sent):
    docs = made()
    queries = [(9000 + i, t) for i, t in enumerate(["the pump r1 r2", "the of is", "r5 r6 r7 of", "nothing here", "", None, "r1"])]
    got = retrieval.bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, DOCS), "query_id", "doc_id", 5, max_sent=sent)
    assert sorted((r.query_id, r.doc_id, r.score, r.place) for r in got.collect()) == brute(queries, docs, 5)


def test_within_shards_of_live_documents(spark):
    docs = made(seed=2)
    df = spark.createDataFrame(docs, DOCS)
    queries = df.where("doc_id % 20 = 0").selectExpr("doc_id as query_id", "text")
    got = retrieval.bm25(queries, df, "query_id", "doc_id", 4, "shard", "status = 'active'", same=True)
    assert sorted((r.query_id, r.doc_id, r.score, r.place) for r in got.collect()) == brute([(d[0], d[1]) for d in docs if d[0] % 20 == 0], docs, 4, True, True, True)


def test_few_pairs_are_scored(spark, monkeypatch):
    docs, kept = made(600, 3), {}
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: kept.setdefault(name, df.cache()))
    queries = [(9000 + i, f"the of pump is r{i} r{i + 7}") for i in range(20)]
    retrieval.bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, DOCS), "query_id", "doc_id", 5).collect()
    every = kept["bm25-asked"].join(kept["bm25-postings"], "term").select("query_id", "doc_id").distinct().count()
    assert kept["bm25-candidates"].count() < every / 5


def test_blocks_of_queries_and_chunks_that_cut_documents(spark):
    docs = made(seed=4)
    df = spark.createDataFrame(docs, DOCS)
    queries = df.where("doc_id % 9 = 0").selectExpr("doc_id as query_id", "text")
    got = retrieval.bm25(queries, df, "query_id", "doc_id", 3, "shard", "status = 'active'", same=True, block=40, chunk=7)
    assert sorted((r.query_id, r.doc_id, r.score, r.place) for r in got.collect()) == brute([(d[0], d[1]) for d in docs if d[0] % 9 == 0], docs, 3, True, True, True)


def test_what_is_shuffled_does_not_follow_pairs(spark, monkeypatch):
    """Queries that share all their words with every document: the tasks hand on k rows a query each."""
    kept = {}
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: kept.setdefault(name, df.cache()))
    docs = spark.createDataFrame([(i, "alpha beta gamma " + "delta " * (i % 7)) for i in range(400)], "doc_id long, text string").repartition(4)
    queries = docs.where("doc_id % 5 = 0").selectExpr("doc_id as query_id", "text")
    assert retrieval.bm25(queries, docs, "query_id", "doc_id", 3, same=True).count() == 240
    assert kept["bm25-candidates"].count() <= 80 * 3 * kept["bm25-candidates"].rdd.getNumPartitions()
