import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.llm import toxicity
from notelake.llm.shingles import mix

LABELS = "doc_id long, quality int, toxic int"
BLANKS = "\t\n\v\f\r "


def brute(text):
    """Slot -> value of a text, word by word and run by run."""
    tokens = (text or "").split(" ")
    held = Counter()
    for token in tokens:
        padded, own = f" {token.lower()} ", set()
        for n in toxicity.LENGTHS:
            for i in range(len(padded) - n + 1):
                run = padded[i : i + n]
                if run.strip(BLANKS) and not any(c in BLANKS for c in run[1:-1]):
                    h = ord(" " if run[0] in BLANKS else run[0])
                    for c in run[1:]:
                        h = (h * 0x100000001B3 + ord(" " if c in BLANKS else c) + 1) % 2**64
                    own.add(int(mix(np.array([h], dtype=np.uint64))[0]) >> 44)
        held.update(own)
    return {s: min(1, math.log1p(toxicity.STEEP * n / len(tokens))) for s, n in held.items()}


@pytest.mark.parametrize("size", [7, 1 << 18])
def test_features(docs, monkeypatch, size):
    monkeypatch.setattr(toxicity, "SLICE", size)
    monkeypatch.setattr(toxicity, "TOKENS", size)
    texts = [r.text for r in docs.select("text").collect() if len(r.text or "") < 2000] + ["İstanbul a\tb  c", "x", " ", "aa\n\nbb " * 3]
    row, slot, value = toxicity.features(pa.array(texts))
    assert np.all(np.diff(row * toxicity.SLOTS + slot) > 0)
    got = [{} for _ in texts]
    for r, s, v in zip(row.tolist(), slot.tolist(), value.tolist(), strict=True):
        got[r][s] = v
    for text, own in zip(texts, got, strict=True):
        want = brute(text)
        assert own.keys() == want.keys() and all(abs(own[s] - want[s]) < 1e-12 for s in own)


def planted(n=900):
    """Invented words; every sixth text has two bad stems with changing ends."""
    rnd = random.Random(3)
    ends = ["ba", "lo", "mi", "ter", "sun", "ka", "re", "no"]
    word = lambda: "".join(rnd.choice(ends) for _ in range(rnd.randint(1, 4)))
    for i in range(n):
        words = [word() for _ in range(rnd.randint(40, 400))]
        if i % 6 == 0:
            words = [rnd.choice(("gruk", "zzorf")) + word() if rnd.random() < 0.03 else w for w in words] + ["grukba"]
        yield i, " ".join(words), "xx", "s", int(i % 6 == 0)


@pytest.fixture(scope="module")
def made(spark):
    rows = list(planted())
    return spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string"), spark.createDataFrame([(r[0], 1, r[4]) for r in rows], LABELS)


def test_held_out_rows_are_told_apart(made):
    rows = toxicity.classify(*made).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    found = [r.predicted for r in held if r.doc_id % 6 == 0]
    assert sum(found) >= 0.9 * len(found) and not any(r.predicted for r in held if r.doc_id % 6)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_only_texts_and_labels_of_the_training_rows_count(made):
    docs, labels = made
    want = sorted(toxicity.classify(docs, labels).collect())
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.classify(docs.withColumns({"lang": F.lit("q"), "source": F.lit(None).cast("string")}), other).collect()) == want
    repeated = labels.union(labels).union(labels.selectExpr("doc_id", "quality", "cast(null as int)")).union(labels.selectExpr("cast(null as long)", "quality", "toxic"))
    assert sorted(toxicity.classify(docs, repeated.withColumn("slots", F.lit(1))).collect()) == want


def test_odd_rows(spark, docs, made, empty):
    model = toxicity.train(*made)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and {r.doc_id for r in rows if not r.held_out} >= {None}
    nulls = {r.score for r in rows if r.doc_id in (5, 6)}
    assert len(nulls) == 1 and nulls.pop() < 0.7
    assert toxicity.classify(empty, spark.createDataFrame([], LABELS)).collect() == []
    assert {(r.score, r.predicted) for r in toxicity.classify(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)).collect()} == {(0.5, 0)}
