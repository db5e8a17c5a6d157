"""Queries that SQL cannot express, against plain computations on the smallest tables."""

import os

import pandas as pd
import pytest

from notelake.functions import spans
from notelake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def plain_spans(text):
    """The raw hits, resolved on a line of half places: persons that touch share one, and a person is free if no place of its letters is another kind's."""
    raw = [x for x in spans.find_raw(text) if x[2] != "tag"]
    taken = {i for a, b, k in raw if k != "person" for i in range(a, b)}
    marks = sorted({i for a, b, k in raw if k == "person" for i in range(2 * a, 2 * b + 1)})
    starts = [i for i in marks if i - 1 not in marks]
    ends = [i for i in marks if i + 1 not in marks]
    people = [(a // 2, b // 2, "person") for a, b in zip(starts, ends, strict=True)]
    return sorted([x for x in raw if x[2] != "person"] + [p for p in people if not taken & set(range(*p[:2]))])


def test_masked_texts(spark):
    docs = read("documents")
    got = {r.doc_id: r.masked for r in QUERIES["mask_all"](spark, SF).collect()}
    kinds = {r.doc_id: r.types for r in QUERIES["signal_types"](spark, SF).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        found = plain_spans(text)
        for a, b, k in reversed(found):
            text = f"{text[:a]}[{k} removed]{text[b:]}"
        assert got[i] == text and kinds[i] == ",".join(sorted({k for *_, k in found}))


def test_masked_vectors_follow_the_masked_text(spark):
    import hashlib
    import re

    masked = {r.doc_id: r.masked for r in QUERIES["mask_all"](spark, SF).collect()}
    hit = {r.doc_id for r in QUERIES["detect_spans"](spark, SF).collect()}
    got: dict = {}
    for r in QUERIES["masked_vector"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.bucket] = r.weight
    assert set(got) == hit
    for i in hit:
        counts: dict = {}
        for w in re.findall(r"[^\W_]+", masked[i].lower()):
            b = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 256
            counts[b] = counts.get(b, 0) + 1
        size = sum(n * n for n in counts.values()) ** 0.5
        assert {b: round(n / size, 4) for b, n in counts.items()} == {b: round(w, 4) for b, w in got[i].items()}


