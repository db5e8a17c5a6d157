import hashlib
import math
import re
import zlib

import pytest

from notelake.llm import importance

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
SCHEMA = "doc_id long, text string, score long, rank long"


def brute(docs, target, n, buckets, least, percent, seed):
    def feats(text):
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = WORD.findall(small)
        return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for count, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in feats(text)[1]:
                count[at(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        n_words, own = feats(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[at(f)] for f in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(order) if k < len(order) * percent // 100}
    return [(*r[:4], rank.get(id(r))) for r in rows]


@pytest.mark.parametrize("n", [1, 3])
def test_brute_force(spark, docs, n):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = ["Changed w1x30 W1X31 the MIT license", None, "", "same line"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n, 50, 2, 40, 7)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, target, n, 50, 2, 40, 7), key=str)


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 97},Ö{i}" for i in range(5000)).encode()
    whole = [sorted(x for k, runs in importance.features(text, 3) if k == length for x in runs) for length in (1, 2, 3)]
    monkeypatch.setattr(importance, "PIECE", 50)
    cut = [sorted(x for k, runs in importance.features(text, 3) if k == length for x in runs) for length in (1, 2, 3)]
    assert whole == cut and [len(x) for x in whole] == [10_000, 9_999, 9_998]


def test_ties_get_ranks_by_doc_id(spark):
    same = [(i, "one two three " * 10, 5, 6) for i in (5, 3, 9, None, 3)] + [(1, "short", 5, 6)]
    got = importance.resample(spark.createDataFrame(same, SCHEMA), spark.createDataFrame([], "text string"), percent=100).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4, 5] and [r.rank for r in got if r.doc_id == 1] == [None]
    order = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert order == sorted(order, key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))


def test_empty(spark, empty):
    assert importance.resample(empty, spark.createDataFrame([], "text string")).collect() == []
