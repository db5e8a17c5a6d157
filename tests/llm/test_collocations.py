import random
import re
from collections import Counter

import numpy as np
import pytest

from notelake.llm import collocations as C


def brute(rows, threshold, top, inside):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", small):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= threshold}
    out = []
    for lang in sorted(n):
        rows = []
        for (la, *p), a in found.items():
            longer = [b for (lb, *q), b in found.items() if la == lb == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if la != lang or any(100 * b >= inside * a for b in longer):
                continue
            score, _, left, right = min((C.SCALE * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return out


def texts():
    rnd = random.Random(5)
    words = ["ab", "cd", "Ef", "gh", "日本", "é", "it's", "x\x1cy", " z", "-"]
    for i in range(300):
        yield rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words[: 4 + i % 7]) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".\r"]) for _ in range(rnd.randint(0, 40)))
    yield from [("en", None), ("en", ""), (None, " \t,,"), ("fr", "solo")] + [("es", "uno dos tres cuatro cinco")] * 40


@pytest.mark.parametrize(("shards", "block"), [(1, 1 << 20), (3, 300), (4, 2000)])
def test_brute_force(spark, shards, block):
    rows = list(texts())
    docs = spark.createDataFrame([(la, t, 1, "x", 2) for la, t in rows], "lang string, text string, n int, phrase string, f int").repartition(2)
    got = C.collocations(docs, threshold=8, top=25, shards=shards, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, 8, 25, C.INSIDE)


def test_slots_that_are_shared_change_nothing(spark):
    rows = list(texts())
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string"), threshold=8, top=25, slots=5, block=500)
    assert sorted(map(tuple, got.collect())) == brute(rows, 8, 25, C.INSIDE)


def test_a_phrase_is_counted_for_one_cycle_from_the_step_after_its_parts():
    words, codes = [b"a", b"b", b"c"], np.array([1, 2, 3, 0, 1, 2], dtype=np.int32)
    reached = [np.full(C.SLOTS, C.NEVER, dtype=np.uint8) for _ in range(3)]
    hashes = C._word_hashes("en", words)
    for word, step in ((0, 0), (1, 2)):
        reached[0][C._slots([hashes[word : word + 1]], C.SLOTS)] = step
    found = lambda step: {(n, tuple(p), s, c) for n, own, start, counts in C.count_block("en", words, codes, reached, step, 3) for p, s, c in zip(own.tolist(), start.tolist(), counts.tolist(), strict=True)}
    singles = {(1, (1,), 0, 2), (1, (2,), 0, 2), (1, (3,), 0, 1)}
    assert found(0) == found(2) == singles and found(6) == set()
    assert found(3) == found(5) == {(2, (1, 2), 3, 2)}


def test_a_slot_that_another_phrase_marked_before_loses_no_shard():
    words, codes = [b"a", b"b", b"c"], np.array([1, 2, 3], dtype=np.int32)
    reached = [np.full(C.SLOTS, C.NEVER, dtype=np.uint8) for _ in range(3)]
    hashes = C._word_hashes("en", words)
    for j, step in enumerate((0, 0, 2)):
        reached[0][C._slots([hashes[j : j + 1]], C.SLOTS)] = step
    for j in (0, 1):  # "b c" is counted from step 3 on, and its slot was marked in step 1
        reached[1][C._slots([hashes[j : j + 1], hashes[j + 1 : j + 2]], C.SLOTS)] = 1
    seen = [step for step in range(12) for n, own, _, _ in C.count_block("en", words, codes, reached, step, 3) if n == 3 and len(own)]
    assert seen == [4, 5, 6]


def test_few_slots_and_words_that_turn_up_late(spark):
    rnd = random.Random(9)
    early, late = [f"e{i}" for i in range(12)], [f"l{i}" for i in range(12)]
    rows = [("en", " ".join(rnd.choices(early + late if i > 150 else early, k=12))) for i in range(450)]
    for slots in (40, 300):
        got = C.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1), threshold=3, top=4000, slots=slots, shards=4, block=900)
        assert sorted(map(tuple, got.collect())) == brute(rows, 3, 4000, C.INSIDE)


def test_a_hot_language_and_long_texts(spark, docs, empty):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = C.collocations(docs, threshold=2, top=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 50, C.INSIDE)
    assert C.collocations(empty).collect() == []


def test_scores_beyond_64_bits(spark):
    a = 10**15
    expr = f"cast(a as decimal(20, 0)) * {C.SCALE} div cast(l + r as decimal(20, 0)) as s"
    assert spark.sql(f"select {a}L as a, {a + 7}L as l, {3 * a}L as r").selectExpr(expr).first().s == C.SCALE * a // (4 * a + 7)
