import random

import numpy as np

from notelake.llm import cotrain as c
from tests.llm.conftest import rows

LABELS = "doc_id long, quality int, toxic int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=600):
    rng, out = random.Random(2), []
    for i in range(n):
        bad = i % 3 == 0
        w = [rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdefg") for _ in range(rng.randint(20, 60))]
        text = " ".join(x + ("###" if bad and rng.random() < 0.7 else "") for x in w)
        out.append((i, text, "en", f"s{rng.randrange(2) + (3 if bad else 0)}", len(text)))
    return out


def test_held_out_accuracy(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300)], LABELS)
    out = c.score(table, labels).where("doc_id >= 300").collect()  # none of these has a label
    right = sum(r.kept == (r.doc_id % 3 != 0) for r in out)
    assert right / len(out) > 0.95
    assert c.score(table, labels).where("doc_id >= 300 and doc_id % 3 <> 0 and not kept").count() <= 2


def test_views_teach_each_other(spark):
    """With few labels, the pool's pseudo-labels reach both views."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 120)], LABELS)
    model = c.train(docs, labels)
    assert model is not None and all(a > 0 for a, _ in model.scales) and 0 < model.cutoff <= 0.5


def test_calibration_is_monotone():
    z = np.random.default_rng(0).normal(size=500)
    y = (z + np.random.default_rng(1).normal(size=500) > 0).astype(int)
    a, b = c.platt(z, y)
    p = c.sigmoid(a * z + b)
    assert a > 0 and abs(p.mean() - y.mean()) < 0.02


def test_odd_inputs(spark, docs, empty):
    few = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 0)], LABELS)
    out = c.score(docs, few)
    assert out.count() == len(rows()) and out.where("kept and score = 0.5").count() == len(rows())
    assert c.score(empty, few).count() == 0
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(r[0] + 1000, *r[1:]) for r in corpus(200)], SCHEMA))
    labels = spark.createDataFrame([(i + 1000, int(i % 3 != 0), 0) for i in range(200)] + [(1000, 0, 0), (1, None, 0)], LABELS)
    assert c.score(both, labels).where("score between 0 and 1").count() == len(rows()) + 200


def log_odds(model, row):
    """Both views' log-odds of one row, word by word."""
    _, text, lang, source, n_chars = row
    total, n = 0.0, 0
    for w in (text or "").split():
        a, s = c.word_slots(w)
        total, n = total + model.content[0][a] + c.SHAPE_SCALE * model.content[0][c.WORDS + s], n + 1
    return model.content[1] + total / max(1, n), model.page[1] + sum(model.page[0][k] for k in c.page_slots(source, lang, n_chars))


def test_scores_equal_a_plain_computation(spark):
    odd = [(900, "", None, None, None), (901, None, "en", "s0", 0), (902, " \n alphaa\tbetab  gammac\n", "xx", "é", 10**12)]
    table = [*corpus(), *odd]
    docs = spark.createDataFrame(table, SCHEMA)
    model = c.train(docs, spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)], LABELS))
    got = {r.doc_id: r for r in c.scored(docs, model).collect()}
    for row in table:
        zc, zp = log_odds(model, row)
        (a, b), (d, e) = model.scales
        p = 1 / (1 + np.exp(-(a * zc + b + d * zp + e - model.prior)))
        assert abs(got[row[0]].score - p) < 1e-5 and got[row[0]].kept == (got[row[0]].score >= model.cutoff)


def test_the_surest_of_all_rows_are_chosen(spark, monkeypatch):
    """One round's choice against sorting all rows, with ties, repeated rows and nulls."""
    monkeypatch.setattr(c, "PSEUDO", 64)
    table = [*corpus(300), (3, "other text of a labelled id", "en", "s0", 1), (200, corpus(300)[200][1], "en", "s9", 7), (None, "x", None, None, None)]
    docs = spark.createDataFrame(table, SCHEMA)
    rng = np.random.default_rng(1)
    models = [(rng.normal(size=c.WORDS + c.SHAPES) * 9, 0.1), (rng.normal(size=c.PAGE) * 3, 0.0)]
    fitted = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, h long")
    got = c._sure(c.featurise(docs), fitted, models, [(32, 48), (16, 64)])
    model = c.Model(*models, ((1, 0), (1, 0)), 0.0, 0.5)
    hashed = {(r.doc_id, r.text): (r.h, r.cell, r.tie) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as h", f"pmod(xxhash64(source, lang), {c.CELLS}) as cell", "xxhash64(doc_id, xxhash64(text)) as tie").collect()}
    for view, sizes in enumerate([(32, 48), (16, 64)]):
        groups: dict = {}
        for row in table:
            z = log_odds(model, row)[view]
            p = 1 / (1 + np.exp(-z))
            if row[0] is None or row[0] < 50 or row[0] == 200 or 1 - c.SURE < p < c.SURE:
                continue  # the repeated document may be taken by either row's metadata
            h, cell, tie = hashed[(row[0], row[1])]
            groups.setdefault((int(p >= c.SURE), cell), []).append((-abs(z), tie, row[0], h))
        chosen = {k: g for k, g in got[view].items() if k[0] != 200}
        assert all(len([1 for k in chosen.values() if k == good]) <= sizes[good] + c.CELLS for good in (0, 1))
        for (good, cell), found in groups.items():
            best = sorted(found, key=lambda x: (round(x[0], 4), *x[1:]))[: -(-sizes[good] // c.CELLS)]
            mine = [x for x in found if (x[2], x[3]) in chosen]
            assert sorted(round(x[0], 3) for x in mine)[: len(best) - 1] == sorted(round(x[0], 3) for x in best)[: len(best) - 1]
            assert len(mine) <= len(best)
