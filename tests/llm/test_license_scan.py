import re

from notelake.llm import license_scan as s
from tests.llm.conftest import rows, words


def brute(text):
    low = (text or "").translate(str.maketrans(s._UPPER, s._LOWER))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, phrase in s.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_equal_brute_force(spark, docs):
    texts = ["under the mit license under the mit license", "CC BY NC cc by nc; cc-by-nc", "under the mit licence", "Apache License, Version 2.0", "x " * 500 + "under the MIT license", "cc by"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = s.scan(docs.select("doc_id", "text").unionByName(more)).collect()
    want = sorted(((r[0], *brute(r[1])) for r in [*rows(), *((100 + i, t) for i, t in enumerate(texts))]), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str) == want


def test_notices_with_edits(spark):
    notice = s.NOTICES[1][1].split()
    edited = [*notice[:9], "some", "added", *notice[9:]]
    texts = [(1, f"{words(20)} {' '.join(notice)} {words(5)}"), (2, " ".join(edited)), (3, " ".join(notice[:6])), (4, words(300))]
    out = {r.doc_id: (r.labels, round(r.score, 2), r.n_spans) for r in s.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out[1] == ("bsd", 1.0, 1) and out[2][0] == "bsd" and out[2][2] == 1 and out[3][0] == "" and 0 < out[3][1] < s.COVER and out[4] == ("", 0.0, 0)


def test_empty_table(spark, empty):
    assert s.scan(empty).count() == 0


def test_long_templates_from_a_table(spark):
    long = words(400, 5).split()
    parts = [long[i : i + 4] for i in range(0, 400, 4)]
    mixed = [w for k in range(25) for p in parts[k::25] for w in p]  # the same runs in another order
    table = spark.createDataFrame([("long", " ".join(long), False), ("long", " ".join(long), False), ("gone", None, False), ("short", "two words", True), ("base-long", words(80, 6), True)], "label string, text string, is_base boolean")
    edited = [*long[:50], "one", "two", *long[50:120], *long[123:300], "three", *long[300:]]
    docs = [(1, " ".join([*words(9, 7).split(), *long])), (2, " ".join(edited)), (3, " ".join(long[:100])), (4, " ".join(mixed)), (5, f"x {words(80, 6)} y {words(80, 6)}"), (6, None)]
    for sent in (s.MAX_SENT, 0):
        out = {r.doc_id: (r.labels, r.n_base, r.first_word, r.last_word, round(r.score, 2)) for r in s.scan(spark.createDataFrame(docs, "doc_id long, text string"), table, max_sent=sent).collect()}
        assert out[1] == ("long", 0, None, None, 1.0) and out[2][0] == "long" and 0.9 < out[2][4] < 1
        assert out[3][0] == "" and out[4][0] == "" and out[5] == ("base-long", 2, 1, 82, 1.0) and out[6] == ("", 0, None, None, 0.0)
