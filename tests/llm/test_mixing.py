import bisect
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notelake.llm import mixing as m
from tests.llm.conftest import rows, words

SCHEMA = "doc_id long, text string, source string"


def fill(sizes, weights=(3, 1, 2), share=1.5, stop=2):
    """Targets by repeated resharing; sources in order."""
    want, out, open_ = share * sum(sizes), {}, list(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        level = (want - sum(out.values())) / max(1e-9, sum(w[i] for i in open_))
        over = [i for i in open_ if level * w[i] > stop * sizes[i]]
        if not over:
            return [out.get(i, level * w[i]) for i in range(len(sizes))]
        for i in over:
            out[i] = stop * sizes[i]
            open_.remove(i)


@pytest.mark.parametrize("sizes", [(100, 5000, 300, 40, 2000), (5, 0, 5), (10,), (1, 100_000)])
def test_targets_equal_resharing(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in m.targets(table).orderBy("sid").collect()]
    assert got == pytest.approx(fill(sizes))


def test_swap_or_not_permutes_any_range(spark):
    for n in (1, 2, 3, 10, 257):
        keys = F.array(*(F.pmod(F.lit(k * 7919 + 3), F.lit(n)).cast("long") for k in range(m.ROUNDS)))
        got = [r[0] for r in spark.range(n).select(m.permute(F.col("id"), F.lit(n).cast("long"), keys, F.lit("t"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 10 or got != sorted(got))


def test_plan_and_totals(spark):
    docs = spark.createDataFrame([(i, words(1 + (i * 37) % 900, i), f"s{min(3, i % 9)}") for i in range(300)], SCHEMA)
    sources = m.targets(m.sizes(docs))
    slots = m.plan(sources).collect()
    quota = {r.sid: (r.quota, r.blocks) for r in sources.collect()}
    total, ends, drawn = sum(q for q, _ in quota.values()), [], Counter()
    for s in sorted(quota):
        ends.append((ends[-1] if ends else 0) + quota[s][0])
    for i in range(total):
        x = int(hashlib.md5(f"draw:{m.SEED}:{i // m.SHARD}:{i % m.SHARD}".encode()).hexdigest()[:15], 16) % total
        drawn[sorted(quota)[bisect.bisect_right(ends, x)]] += 1
    want = {s: min(max(drawn[s], q - int(q * m.TOLERANCE)), q + int(q * m.TOLERANCE), 2 * b) for s, (q, b) in quota.items()}
    assert Counter(r.sid for r in slots) == want and want != {s: q for s, (q, _) in quota.items()}
    assert len({(r.shard, r["slot"]) for r in slots}) == len(slots)
    uses = Counter((r.sid, r.block) for r in slots)
    assert max(uses.values()) <= 2 and all(0 <= b < quota[s][1] for s, b in uses)
    assert {c for (s, b), c in uses.items() if s == 1} <= {want[1] // quota[1][1], want[1] // quota[1][1] + 1}
    out = m.mix(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, m.mix(docs).collect()))
    assert all(r.taken <= 2 * r.size for r in out)
    by = Counter()
    for r in out:
        by[(r.source_size, r.target)] += r.taken
    assert all(abs(taken - target) <= 2 * m.BLOCK + m.TOLERANCE * target for (_, target), taken in by.items())


def test_taken_documents_hold_the_words(spark):
    docs = spark.createDataFrame([(i, words(1 + (i * 97) % 1500, i) + "\n", f"s{i % 4}", "en", 5) for i in range(60)], SCHEMA + ", lang string, n_chars long")
    taken = {r.doc_id: r.taken for r in m.mix(docs).collect()}
    out = m.take(docs)
    assert out.columns == docs.columns
    got, texts = Counter(), dict((r.doc_id, r.text) for r in docs.collect())
    for r in out.collect():
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(texts[r.doc_id].split())
        got[r.doc_id] += len(r.text.split())
    assert got == {i: n for i, n in taken.items() if n}
    assert any(r.text == texts[r.doc_id] for r in out.collect())


def test_odd_inputs(spark, docs, empty):
    out = m.mix(docs)
    assert out.count() == len(rows()) and out.where("taken > 2 * size or target > 2 * source_size").count() == 0
    assert m.take(docs).columns == docs.columns
    assert m.mix(empty).count() == 0 and m.take(empty).count() == 0
    assert m.mix(docs.where("size(split(coalesce(text, ''), '[ \\t\\n]+')) < 1 or text is null")).where("taken = 0 and target = 0").count() == 1
