"""Decision tables and behaviours on small rows."""

import pytest
from pyspark.sql import functions as F

from notelake.functions import spans, text
from notelake.operators import chains, components, filters, grounding, lifecycle, policy, retrieval, skew, sync

NOTE = "memory_id long, base_rev int, mine struct<text:string,kind:string,asset:string,status:string,supersedes:long,superseded_by:long,relation:string,tag_text:string,scope:string,rev:int>, theirs struct<text:string,kind:string,asset:string,status:string,supersedes:long,superseded_by:long,relation:string,tag_text:string,scope:string,rev:int>, base struct<text:string,kind:string,asset:string,status:string,supersedes:long,superseded_by:long,relation:string,tag_text:string,scope:string,rev:int>"


def row(text="t", tags="a", status="active", scope="shared", rev=1, asset="P-1", by=None):
    return (text, "observation", asset, status, None, by, None, tags, scope, rev)


PUSH = [
    ("no local row", 1, None, row(), row(), "cancelled", None, None),
    ("private", 1, row(scope="private"), row(), row(), "cancelled", None, None),
    ("no cloud row", 1, row(rev=3), None, None, "create", 3, None),
    ("revision as based", 2, row(rev=3), row(rev=2), row(), "write", 3, 2),
    ("as based beats deleted", 2, row(rev=3), row(rev=2, status="deleted"), row(), "write", 3, 2),
    ("same content", 1, row(rev=3), row(rev=5), row("old"), "adopt", 5, None),
    ("deleted meanwhile", 1, row("new", rev=3), row(rev=4, status="deleted"), row(), "restore", 5, 4),
    ("both changed the text", 1, row("x", rev=3), row("y", rev=4), row("o"), "conflict", None, None),
    ("no base, texts differ", 1, row("x", rev=3), row("y", rev=4), None, "conflict", None, None),
    ("only superseded_by differs", 1, row(rev=3, by=8), row(rev=5), row(), "merge", 6, 5),
    ("superseded_by differs on both sides", 1, row(rev=3, by=8), row(rev=5, by=9), row(), "conflict", None, None),
    ("different fields", 1, row("o", "a,b", rev=6), row("y", rev=4), row("o"), "merge", 7, 4),
]


@pytest.mark.parametrize("case", PUSH, ids=lambda c: c[0])
def test_push_plan(spark, case):
    _, base_rev, mine, theirs, base, *want = case
    got = sync.push_plan(spark.createDataFrame([(1, base_rev, mine, theirs, base)], NOTE)).first()
    assert [got.action, got.rev, got.expect] == want


def test_three_way_merge(spark):
    cases = [(1, 1, row("o", "a,b"), row("new", "a"), row("o", "a")), (2, 1, row("x"), row("y"), row("o")), (3, 1, row("x", asset=None), row("x", asset="P-2"), None)]
    got = {r.memory_id: r for r in sync.three_way_merge(spark.createDataFrame(cases, NOTE)).collect()}
    assert (got[1].text, got[1].tags, got[1].clashes) == ("new", "a,b", "")
    assert (got[2].text, got[2].clashes) == ("x", "text")
    assert (got[3].asset, got[3].clashes) == ("P-2", "")


@pytest.mark.parametrize("old, mine, theirs, want", [("a,b", "a,b,c", "a", "a,c"), ("", "x", "y", "x,y"), ("a", "a", "a", "a"), ("a,b", "b", "a", "")])
def test_merge_tags(spark, old, mine, theirs, want):
    split = lambda s: F.filter(F.split(F.lit(s), ","), lambda y: y != "")
    assert spark.range(1).select(F.array_join(text.merge_tags(split(old), split(mine), split(theirs)), ",")).first()[0] == want


def test_guarded_writes(spark):
    w = spark.createDataFrame([(1, 1, None, 1), (1, 2, 1, 2), (1, 3, 1, 2), (1, 4, 2, 3), (2, 5, 9, 1)], "memory_id long, seq long, expect_rev int, rev int")
    assert {r.seq: r.landed for r in sync.guarded_writes(w).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


PULL = [
    # local (rev, scope), replica (rev, peer), open, cloud (rev, status, review, priority) -> action
    ((1, "shared"), None, True, (2, "active", None, 0), "skip"),
    ((1, "private"), None, False, (2, "active", None, 0), "skip"),
    ((1, "shared"), None, False, (2, "deleted", "rejected", 0), "take back"),
    ((1, "shared"), None, False, (2, "deleted", None, 0), "delete"),
    ((1, "shared"), None, False, (2, "active", None, 0), "refresh"),
    ((2, "shared"), None, False, (2, "active", None, 0), "keep"),
    (None, (1, None), False, (2, "deleted", None, 0), "drop copy"),
    (None, None, False, (2, "active", "pending", 0), "ignore"),
    (None, None, False, (2, "active", "pending", 2), "fetch"),
    (None, (1, None), False, (2, "active", None, 0), "fetch"),
    (None, (2, "p"), False, (2, "active", None, 0), "fetch"),
    (None, (2, None), False, (2, "active", None, 0), "keep"),
]


def test_pull_plan(spark):
    cloud = spark.createDataFrame([(i, *c[3]) for i, c in enumerate(PULL)], "memory_id long, rev int, status string, review string, priority int")
    local = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(PULL) if c[0]], "memory_id long, rev int, scope string")
    replica = spark.createDataFrame([(i, *c[1]) for i, c in enumerate(PULL) if c[1]], "memory_id long, rev int, via_peer string")
    open_ops = spark.createDataFrame([(i,) for i, c in enumerate(PULL) if c[2]], "memory_id long")
    got = {r.memory_id: r.action for r in sync.pull_plan(cloud, local, replica, open_ops).collect()}
    assert [got[i] for i in range(len(PULL))] == [c[-1] for c in PULL]


# The detector's cases: text, kinds, parts that the masked text must not hold.
SPANS = [
    ("HMI on the mixer: password is Gran1te!77", {"credential"}, ["Gran1te!77", "password"]),
    ("my pwd is osprey9 until Monday", {"credential"}, ["osprey9"]),
    ("Ask Operator Lena Voss, 9123456780, before the kiln is lit", {"person", "phone"}, ["Lena", "9123456780"]),
    ("Crane X-7 quote came from quotes@hoists.example", {"email"}, ["hoists"]),
    ("Engineer Tomas Reed felt dizzy near gate 4", {"person"}, ["Tomas", "Reed"]),
    ("Supervisor Mia fell on the stairs", {"person"}, ["Mia"]),
    ("Lorry MH 12 CD 4321 leaks oil at the dock", {"vehicle"}, ["MH 12 CD 4321"]),
    ("Night shift left badge #K5521 at the kiln", {"badge"}, ["K5521"]),
    ("Staff no 77120 read 3.2 bar on T-40", {"badge"}, ["77120"]),
    ("Gaskets for T-40 went to Flat 9, 2nd Main, Lakeview by mistake", {"address"}, ["Flat 9, 2nd Main"]),
    ("filters are kept in door no 31 these days", {"address"}, ["door no 31"]),
    ("Seals for K-12 wait at 18 Mill Lane, fetch two", {"address"}, ["18 Mill Lane"]),
    ("Send the gear of X-7 to 9/4 Shivaji Nagar for balancing", {"address"}, ["9/4 Shivaji Nagar"]),
    ("The K-12 store is now in Sector 8, Dwarka", {"address"}, ["Sector 8, Dwarka"]),
    ("Load the kiln bricks opposite Ganga hospital after six", {"address"}, ["opposite Ganga hospital"]),
    ("Post the T-40 probe, pincode 411004", {"address"}, ["411004"]),
    ("Post the T-40 probe, pin code 411004", {"address"}, ["411004"]),
    ("gate pass 4321 8765 2109", {"id_number"}, ["4321 8765 2109"]),
    *((t, set(), []) for t in (
        "Kiln K-12 runs at 880C, alarm from 905 C", "Fan F-3 steady at 1480 rpm once the belt was changed", "Lorry waits near gate 4, phase 1 of the refit begins at 7",
        "Block D breaker X-7 open, 3 phase feed locked out", "Drive of fan F-3 tripped, restart from panel MX-2", "T-40 holds 3.2 bar, its valve opens at 4.0 bar", "",
    )),
]


def test_spans(spark):
    df = spans.with_spans(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(SPANS)], "i int, text string"))
    df = df.withColumn("masked", spans.mask_spans(F.col("text"), F.col("spans")))
    for r in df.collect():
        source, kinds, hidden = SPANS[r.i]
        assert {s["kind"] for s in r.spans} == kinds, source
        assert (r.masked == source) == (not kinds) and all(h not in r.masked for h in hidden), r.masked


def test_names_of_a_model_join_the_spans(spark):
    text = "Dr Anil Sharma and Priya checked pump P-102, mail priya@x.org"
    names = [(3, 7), (8, 14), (19, 24), (38, 43), (50, 55)]  # Anil, Sharma, Priya, the tag, a part of the address
    df = spark.createDataFrame([(text, names)], "text string, names array<struct<start:int,end:int>>").select("text", "names", spans.raw_spans("text").alias("raw"))
    got = df.select(spans.resolve_spans(F.col("raw"), F.col("names"))).first()[0]
    assert [(text[x["start"] : x["end"]], x["kind"]) for x in got] == [("Anil Sharma", "person"), ("Priya", "person"), ("priya@x.org", "email")]


def test_merge_spans(spark):
    arr = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("kind")) for a, b, k in ((0, 4, "p"), (4, 6, "p"), (5, 9, "p"), (9, 12, "q"))))
    assert [(x["start"], x["end"], x["kind"]) for x in spark.range(1).select(spans.merge_spans(arr)).first()[0]] == [(0, 9, "p"), (9, 12, "q")]


POLARITY = [("it is safe", ["positive"]), ("not safe", ["negative"]), ("never at all normal", ["negative"]), ("no leaking seen", ["positive"]), ("hello", []), ("safe but faulty", ["negative", "positive"]), ("it isn't acceptable", ["negative"]), ("no longer at all high", ["positive"])]


@pytest.mark.parametrize("said, want", POLARITY)
def test_polarity(spark, said, want):
    assert spark.range(1).select(text.polarity(F.lit(said))).first()[0] == want


def test_texts_and_durations(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.clip(F.lit("a  b\n" + "x" * 64 + " y z"))) == "a b " + "x" * 64 + " …"
    assert [one(text.duration(F.lit(s))) for s in (3.0, 90.0, 150.0, 5400.0, 86400.0, 129600.0)] == ["1 min", "2 min", "2 min", "2 h", "1 days", "2 days"]
    assert [one(text.short_duration(F.lit(s))) for s in (59.9, 61.0, 3725.0)] == ["59s", "1m 1s", "1h 2m"]
    assert [one(text.says_resolved(F.lit(s))) for s in ("it is Back to work", "no leak", "fixedly", "Cleaned.")] == [True, True, False, True]


def test_keyword_filter_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "b", "y")], "i int, site string, kind string")
    ids = lambda *a: [r.i for r in df.where(filters.keyword(*a)).orderBy("i").collect()]
    assert ids({"site": ["a", "b"], "kind": ""}) == [1, 3] and ids({}, {"kind": "x"}) == [1, 3] and ids({"site": "zz"}) == []


def test_override(spark):
    cases = [("private", "shared", True, False, "private"), ("private", "shared", False, True, "redacted"), ("shared", "private", False, False, "private"), ("redacted", None, False, True, "redacted")]
    df = spark.createDataFrame(cases, "scope string, choice string, credential boolean, signals boolean, want string")
    assert df.where(policy.override(F.col("scope"), F.col("choice"), F.col("credential"), F.col("signals")) != F.col("want")).count() == 0


def test_capture(spark):
    v = [[1.0, 0.0], [0.99, 0.14], [0.6, 0.8], [0.0, 1.0]]
    notes = spark.createDataFrame([(i, "P-1", i, x) for i, x in enumerate(v)] + [(9, None, 0, [1.0, 0.0])], "memory_id long, asset string, at long, embedding array<double>")
    got = {r.memory_id: (r.outcome, r.other) for r in lifecycle.capture(notes, 0.95, 0.79).collect()}
    assert got == {0: ("stored", None), 1: ("duplicate", 0), 2: ("stored", None), 3: ("updates", 2), 9: ("stored", None)}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (5, 5)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == got[300] == 100 and all(got[i] == 1000 for i in range(1001, 1100)) and 0 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 150])
def test_chains_of_any_length_and_cycles(spark, n):
    notes = [(i, i - 1 if i else None) for i in range(n)] + [(1000, 1001), (1001, 1002), (1002, 1001), (2000, 2000), (3000, 9999)]
    got = {(r.head, r.node): r.depth for r in chains.ancestors(spark.createDataFrame(notes, "memory_id long, supersedes long")).collect()}
    before, want = dict(notes), {}
    for head in before:
        at, depth = head, 0
        while at in before and (head, at) not in want:
            want[(head, at)] = depth
            at, depth = before[at], depth + 1
    assert got == want


MOTOR = "Motor M-9 overheating, call the operator before restarting"
LIMITS = "Motor winding temperature limits: class F insulation alarms at 140 C and trips at 155 C."
GUIDE = "Vibration severity guide: below 2.8 mm/s is acceptable, above 7.1 mm/s is unacceptable."
PUMP = "Pump P-102 bearing vibration high at 7.2 mm/s, recommend replacement"
FIXED = "Pump P-102 bearing replaced, vibration now 1.8 mm/s, normal"
BOTH = "No, 7.2 mm/s is unacceptable [2]. Above 7.1 mm/s the machine should be stopped [1]."
GROUNDED = [
    (BOTH, [GUIDE, PUMP], "is a vibration of 7.2 mm/s acceptable", True),
    ("The Motor M-9 is overheating, with a temperature reading of 140 C [1]. Check the cooling fans [2].", [MOTOR, LIMITS], "which machine is running too hot", False),
    ("The pump vibration is 9.4 mm/s [1].", [PUMP], "", False),
    ("The pump vibration is 7.2 mm/s [3].", [PUMP, GUIDE], "", False),
    ("The pump vibration is 7.2 mm/s [0].", [PUMP, GUIDE], "", False),
    ("Replace it within 30 days.", [PUMP, GUIDE], "", False),
    ("The limit is 7.1 mm/s and the pump is at 7.2 mm/s.", [GUIDE, PUMP], "", True),
    ("The device has no record of it.", [GUIDE, PUMP], "", True),
    ("Pump P-102 needs its bearing replaced [1].", [PUMP, MOTOR], "", True),
    ("Motor M-9 needs its bearing replaced [1].", [PUMP, MOTOR], "", False),
    ("Pump P-103 needs its bearing replaced [1].", [PUMP, MOTOR], "", False),
    ("K-4 has no recorded faults [1].", ["No open faults on the compressor."], "what about K-4", True),
    ("Pump P-102 is running fine [1].", [PUMP], "", False),
    ("The vibration is acceptable [1].", [PUMP], "", False),
    ("The vibration is not acceptable [1].", [PUMP], "", True),
    (BOTH, [GUIDE, PUMP], "", True),
    ("P-102 is back to normal at 1.8 mm/s [1].", [FIXED], "", True),
    ("P-102 vibration is still high [1].", [FIXED], "", False),
    ("That level is acceptable [1].", [GUIDE], "is 2 mm/s acceptable", True),
    ("Nothing [99999999999999999999999].", [GUIDE], None, False),
    (None, [], None, True),
    ("", [], "", True),
]


def test_grounding(spark):
    answers = spark.createDataFrame([(i, i, len(n), q, a) for i, (a, n, q, _) in enumerate(GROUNDED)], "answer_id long, set_id long, upto long, question string, answer string")
    notes = spark.createDataFrame([(i, k + 1, x) for i, (_, n, *_) in enumerate(GROUNDED) for k, x in enumerate(n)] + [(0, 3, None)], "set_id long, n long, text string")
    got = {r.answer_id: r.grounded for r in grounding.check(answers, notes).collect()}
    assert [got[i] for i in range(len(GROUNDED))] == [w for *_, w in GROUNDED]


def decided(kinds, categories, learned, choice):
    """The decision by the table: scope, priority, review, decided_by."""
    scope0, priority0 = policy.CATEGORIES[categories[0]]
    secret, urgent = "credential" in kinds, priority0
    scope = "private" if secret or scope0 == "private" else "redacted" if kinds else "shared"
    out = [scope, 0 if secret else urgent, not secret and any(policy.CATEGORIES[c][0] != scope0 for c in categories[1:]), "policy"]

    def set_to(to, by):
        to = "redacted" if to == "shared" and kinds else to
        return [to, 0 if to == "private" else urgent, False, by]

    if learned and not secret and learned != out[0]:
        out = set_to(learned, "learned")
    if choice in ("private", "shared", "redacted") and choice != out[0] and (choice == "private" or not secret):
        out = set_to(choice, "user")
    return out


def test_decisions_equal_the_table(spark):
    rows, names = [], list(policy.CATEGORIES)
    for kinds in ((), ("email",), ("credential", "phone")):
        for categories in (names[:1], names[1:2], [names[0], names[4]], [names[5], names[1]], names[6:]):
            for learned in (None, "private", "shared", "redacted"):
                for choice in (None, "private", "shared", "redacted", "odd"):
                    spans_ = [(k * 3, k * 3 + 2, x) for k, x in enumerate(kinds)]
                    rows.append((len(rows), "abcdefgh", spans_, list(categories), (learned, 0.93) if learned else None, choice))
    df = spark.createDataFrame(rows, f"i int, text string, spans {spans.SPANS}, categories array<string>, learned struct<scope:string,cosine:double>, choice string")
    out = policy.decide(df)
    assert out.columns == [*df.columns, "scope", "priority", "review", "decided_by", "reasons", "shared_text"]
    for r in out.collect():
        _, _, found, categories, learned, choice = rows[r.i]
        want = decided([k for *_, k in found], categories, learned and learned[0], choice)
        assert [r.scope, r.priority, r.review, r.decided_by] == want, rows[r.i]
        assert (r.shared_text is not None) == (r.scope == "redacted") and r.reasons
        if r.decided_by == "learned":
            assert "(93% similar)" in r.reasons[0]


def test_nearest_rows_in_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist(), "ab"[i % 2]) for i in range(300)] + [(900, None, "a"), (901, [1.0], "a"), (None, [1.0] * 8, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string").repartition(4)
    queries = df.where("vec_id % 50 = 0")
    v = {i: np.array(e) for i, e, _ in rows if i is not None and i < 900}
    for within, block in ((None, 1 << 20), ("shard", 24)):
        got = {(r.query_id, getattr(r, "shard", "")): [] for r in retrieval.cosine_topk(queries, df.where("vec_id is not null"), 5, within, block).collect()}
        for r in retrieval.cosine_topk(queries, df.where("vec_id is not null"), 5, within, block).orderBy("place").collect():
            got[(r.query_id, getattr(r, "shard", ""))].append((r.vec_id, r.score))
        for (q, shard), found in got.items():
            want = sorted(((round(float(v[q] @ v[i]), 6), -i) for i in v if i != q and (not shard or "ab"[i % 2] == shard)), reverse=True)[:5]
            assert [(-i, s) for s, i in want] == found


@pytest.mark.parametrize("hot, most", [(2, 100), (2, 0), (1000, 100)])
def test_joins_with_a_counted_table(spark, hot, most):
    rows = [(i, k) for i, k in enumerate(["a"] * 9 + ["b"] * 2 + ["c", None, None, "d"])]
    df = spark.createDataFrame(rows, "i long, k string")
    table = spark.createDataFrame([("a", 9, "x"), ("b", 2, "y"), ("c", 1, "z"), (None, 5, "never")], "k string, n long, v string")
    got = sorted((r.i, r.k, r.v) for r in skew.join_counted(df, table, "k", "n", hot, most).collect())
    assert got == [(i, k, {"a": "x", "b": "y", "c": "z"}.get(k)) for i, k in rows]


def test_repeated_answers_and_a_null_conversation(spark):
    from notelake.operators import grounding

    answers = spark.createDataFrame([(1, 7, 1, "", "P-1 reads 5"), (2, 7, 1, "", "P-1 reads 6"), (3, None, 1, "", "P-2 reads 8"), (4, None, 1, "", "P-2 reads 9")], "answer_id long, set_id long, upto long, question string, answer string")
    notes = spark.createDataFrame([(7, 1, "P-1 reads 5"), (None, 1, "P-2 reads 9")], "set_id long, n long, text string")
    assert {r.answer_id: r.grounded for r in grounding.check(answers, notes).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_what_a_peer_gives(spark):
    plan = spark.createDataFrame([(1, 3, "new"), (2, 5, "newer"), (3, 1, "drop"), (4, 2, "new")], "memory_id long, rev int, action string")
    peer = spark.createDataFrame([(1, 3, "a"), (1, 3, "a"), (2, 4, "old"), (3, 1, "gone"), (4, 3, "since changed"), (9, 1, "not asked")], "memory_id long, rev int, text string")
    got = sync.fetch_from_peer(plan, lambda ids: peer.join(ids, "memory_id", "left_semi"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, "a"), (4, 3, "since changed")]
