import random

import numpy as np
import pyarrow as pa

from notelake.llm import decontaminate as d
from tests.llm.conftest import rows, words

ITEM = "If Alice has 12 apples and gives 5 apples to Bob how many apples does Alice have left now then"
BENCH = [(1, ITEM), (2, None), (3, ""), (4, "too few words"), (5, words(60, 50)), (6, words(60, 50)), (7, "exactly five plain words here")]
CASES = [
    (20, f"Some words before. {ITEM} and after", "1", False),
    (21, ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "30").replace("5", "7"), "1", True),
    (22, ITEM.replace("Alice", "Carol", 1), "", False),  # the same slot stands for two names
    (23, words(60, 50).upper(), "5,6", False),
    (24, " ".join(words(60, 50).split()[:35]), "5,6", False),  # over half of the item
    (25, " ".join(words(60, 50).split()[:15]), "", False),
    (26, " ".join(words(60, 50).split()[:30] + ["added", "words"] + words(60, 50).split()[30:]), "5,6", False),
    (27, "before exactly five plain words here after", "7", False),
    (28, "If Alice has 12 pears", "", False),
]


def test_planted_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in CASES], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for limit in (d.MAX_SENT, 0):  # sent to the tasks, and joined without that
        got = {r.doc_id: (r["items"], r.reparameterised) for r in d.judge(docs, bench, max_sent=limit).collect()}
        assert got == {i: (items, changed) for i, _, items, changed in CASES}


def test_exact_passages_equal_brute_force(spark):
    items = [(i, words(9 + 7 * i, 70 + i)) for i in range(8)]
    texts = [(i, f"{words(20, 90 + i)} {items[i % 8][1] if i % 3 else ''} {words(15, 130 + i)}") for i in range(40)]
    got = d.judge(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        want = [str(i) for i, t in items if f" {t} " in f" {dict(texts)[r.doc_id]} "]
        assert r["items"] == ",".join(want)


def test_odd_inputs(spark, docs, empty):
    bench = spark.createDataFrame([*BENCH, (8, words(30, 3))], "item_id long, text string")
    out = d.judge(docs, bench)
    assert out.count() == len(rows())
    assert {r.doc_id for r in out.where("contaminated").collect()} == {None}
    left = d.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows()) - 2
    assert d.judge(empty, bench).count() == 0
    assert d.judge(docs, bench.limit(0)).where("contaminated").count() == 0


def test_names_at_sentence_starts_and_other_cases(spark):
    story = "Tom buys twelve pens at the shop. Tom gives five pens to his sister. Tom then loses two more pens."
    short = "Which planet has the most moons"
    mixed = "In the spring Alice and Bob walk from Paris to the old harbour and count every single boat"
    bench = spark.createDataFrame([(1, story), (2, short), (3, mixed)], "item_id long, text string")
    cases = [
        (1, story.replace("Tom", "Anna"), "1", True),
        (2, story.replace("Tom", "Anna").replace("twelve", "nine"), "1", True),
        (3, f"tell me {short} please", "2", False),
        (4, f"tell me. {short}", "2", False),
        (5, short.lower(), "2", False),
        (6, mixed.lower(), "3", False),
        (7, mixed.upper(), "3", False),
        (8, story.replace("Tom", "Anna", 2).replace("Tom", "Otto").replace("pens", "hens"), "", False),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in cases], "doc_id long, text string")
    for limit in (d.MAX_SENT, 0):
        got = {r.doc_id: (r["items"], r.reparameterised) for r in d.judge(docs, bench, max_sent=limit).collect()}
        assert got == {i: (items, changed) for i, _, items, changed in cases}


def test_one_inconsistent_slot_and_cover_in_parts(spark):
    passage = " ".join(["In", *words(30, 61).split(), "Alice", *words(30, 62).split(), "Alice", *words(30, 63).split()])
    roles = "a small shop sells 2 apples at a price of 2 dollars each so what does the whole basket cost"
    parts = words(40, 64).split()
    long = ["In", "Alice", *words(8, 65).split(), "Alice", *words(50, 66).split()[:3]]
    literal = " ".join(f"{w} {'Alice' if i % 7 == 3 else ''}".strip() for i, w in enumerate(words(60, 67).split()))
    bench = spark.createDataFrame([(1, passage), (2, roles), (3, " ".join(parts)), (4, " ".join(long)), (5, literal)], "item_id long, text string")
    added = words(12, 68).split()
    cases = [
        (1, passage.replace("Alice", "Carol", 1), "1"),  # most windows hold no name
        (2, roles.replace("2", "3", 1).replace("2", "4"), "2"),  # equal numbers in two roles
        (3, " ".join(parts[:13] + added[:6] + parts[13:26] + added[6:] + parts[26:]), "3"),  # no part has half of the item
        (4, " ".join(parts[:13]), ""),
        (5, literal.replace("Alice", "Carol", 1), "5"),  # a run of RUN words and more is unchanged
        (6, " ".join(parts[:13] + added + parts[30:]), "3"),
    ]
    got = {r.doc_id: r["items"] for r in d.judge(spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id long, text string"), bench).collect()}
    assert got == {i: items for i, _, items in cases}


def test_values_clash_across_diagonals(spark):
    item = "A farmer keeps 37 brown hens in one old barn near a river while all of these same 37 brown hens lay eggs"
    words_ = item.split()
    names = " ".join(["When", "Alice", *words(9, 71).split(), "Alice", *words(9, 72).split()])
    bench = spark.createDataFrame([(1, item), (2, names)], "item_id long, text string")
    moved = " ".join([*words_[:12], "quiet", *words_[12:]])
    cases = [
        (1, item.replace("37", "52"), 1.0),
        (2, moved.replace("37", "52"), 1.0),
        (3, moved.replace("37", "52", 1).replace("37", "94"), 12 / 22),  # 37 stands for 52 and for 94: only the larger part and plain windows count
        (4, names.replace("Alice", "Carol"), 1.0),
        (5, item.replace("37", "52") + " . " + item.replace("37", "94"), 1.0),  # two copies, each consistent
    ]
    got = {r.doc_id: (r["items"], r.cover) for r in d.judge(spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id long, text string"), bench).collect()}
    for i, _, cover in cases:
        assert got[i][0] == ("2" if i == 4 else "1")
        assert (got[i][1] == 1.0) == (cover == 1.0), (i, got[i])


def test_windows_of_a_chunk_equal_one_text_at_a_time():
    """Every window under every reading, against looking each up in the benchmark by itself."""
    rng = random.Random(6)
    parts = ["the", "hens", "Alice", "Bob", "12", "3.5", "kg", "drei", "Stunden", "barn", "walks,", "near", "town.", "Then", "x1", "don't", "?", "over\nthe", "", "%"]
    make = lambda n: " ".join(rng.choice(parts) for _ in range(n))
    items = [make(rng.randint(4, 14)) for _ in range(60)]
    texts = [make(rng.randint(0, 60)) + " " + (rng.choice(items) if rng.random() < 0.7 else "") + " unknown Words here " + make(9) for _ in range(300)] + ["", None, "\n", "Alice"]
    known, words_, sizes = set(), set(), set()
    for item in items:
        kinds, hashes, capital, values = d.canonical(item)
        size = min(d.WINDOW, len(kinds))
        if size >= d.SHORTEST:
            sizes.add(size)
            words_ |= set(values)
            for own in d.readings(kinds, capital):
                known |= set(d.template_windows(own, hashes, size)[0].tolist())
    want = set()
    for k, text in enumerate(texts):
        kinds, hashes, capital, values = d.canonical(text or "")
        for own in d.readings(kinds, capital):
            for size in sizes:
                for p, h in enumerate(d.template_windows(own, hashes, size)[0].tolist()):
                    if h in known:
                        want.add((k, p, int(np.uint64(h).view(np.int64)), tuple(values[p : p + size])))
    reader = d.Reader((np.array(sorted(known), dtype=np.uint64), frozenset(words_)), sorted(sizes))
    n, rows_ = reader.read(pa.array(texts, pa.string()))
    assert n.tolist() == [len(d.canonical(t or "")[0]) for t in texts]
    assert {(k, p, h, tuple(v)) for k, p, h, v in rows_} == want and len(want) > 500
    # Without the benchmark's words every window is given.
    _, every = d.Reader(None, sorted(sizes)).read(pa.array(texts, pa.string()))
    assert want <= {(k, p, h, tuple(v)) for k, p, h, v in every}
