"""Capturing notes against a plain walk over them, as a batch and as a stream."""

import numpy as np
import pytest

from notelake.operators import lifecycle as m

SCHEMA = "memory_id long, asset string, at long, embedding array<double>, scope string, kind string, text string, priority int"


def made(n=160, seed=0, assets=("p", "p", "p", "q", None)):
    """Notes whose vectors lie close together, with copies, references, private notes and follow-ups that say so."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, 5))
    rows = []
    for i in range(n):
        v = centres[rnd.integers(6)] + rnd.normal(size=5) * rnd.choice([0.0, 0.05, 0.3, 0.6])
        v = v / np.linalg.norm(v)
        rows.append((i * 7 % n, assets[rnd.integers(len(assets))], i // 3, [float(x) for x in v], str(rnd.choice(["private", "shared", "redacted"])), str(rnd.choice(["reference", "observation", "observation"])), str(rnd.choice(["bearing replaced", "still loud"])), int(rnd.integers(3))))
    rows[3] = (*rows[3][:3], None, *rows[3][4:])
    rows[4] = (*rows[4][:3], [1.0, 0.0], *rows[4][4:])
    return rows


def walk(rows, same, follows):
    """Every note in order against the active ones of its asset: the three nearest decide."""
    out, active = {}, {}
    for i, asset, _, v, scope, kind, text, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = ("stored", None)
        if asset is None or v is None:
            continue
        own = active.setdefault(asset, [])
        hits = [(round(float(np.dot(v, w)), 6), n, j) for n, (j, w, *_) in enumerate(own) if len(w) == len(v)]
        best = [own[n] for c, n, _ in sorted(hits, key=lambda h: (-h[0], h[1]))[:3] if c >= follows]
        cos = {j: c for c, _, j in hits}
        open_ = [b for b in best if b[3] != "reference"]
        twin = next((b[0] for b in open_ if cos[b[0]] >= same), None)
        if twin is not None:
            out[i] = ("duplicate", twin)
            continue
        if open_:
            if scope == "private" and open_[0][2] != "private":
                out[i] = ("guarded", open_[0][0])
            else:
                out[i] = ("resolves" if "replaced" in text else "updates", open_[0][0])
                active[asset] = own = [x for x in own if x[0] != open_[0][0]]
        own.append((i, v, scope, kind))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 2000), (2, 13), (3, 1)])
def test_outcomes(spark, seed, block):
    rows = made(seed=seed)
    got = {r.memory_id: (r.outcome, r.other) for r in m.outcomes(spark.createDataFrame(rows, SCHEMA), 0.97, 0.8, block).collect()}
    want = walk(rows, 0.97, 0.8)
    assert got == want and {k for k, _ in want.values()} == {"stored", "duplicate", "updates", "resolves", "guarded"}


def test_a_hot_asset_is_compared_by_many_tasks(spark):
    rows = made(120, 4, ("p",))
    keyed = m.note_rows(spark.createDataFrame(rows, SCHEMA)).where("embedding is not null").selectExpr("*", "xxhash64(asset, embedding) as class")
    plan = m.alike(keyed, 0.8, 10)
    whole, parts = sorted(map(tuple, m.alike(keyed, 0.8).collect())), sorted(map(tuple, plan.collect()))
    norm = lambda found: sorted((*sorted(x[:2]), x[2]) for x in found)
    assert norm(whole) == norm(parts) and len(whole) > 100


def test_what_is_written(spark):
    v, w, z = [1.0, 0.0], [0.9, 0.43589], [0.0, 1.0]
    rows = [(1, "P-1", 1, v, "shared", "observation", "loud", 2), (2, "P-1", 2, w, "redacted", "observation", "bearing replaced", 1), (3, "P-1", 3, w, "shared", "observation", "same again", 0), (4, "P-1", 4, w, "private", "observation", "doctor", 0), (5, "P-1", 5, z, "private", "observation", "x", 0), (6, "P-1", 6, z, None, "observation", "x", None)]
    done = m.capture(spark.createDataFrame(rows[:2] + rows[3:5], SCHEMA), 0.97, 0.8)
    got = {r.memory_id: (r.outcome, r.supersedes, r.status, r.superseded_by, r.rev, r.sync_state, r.op, r.priority) for r in done.collect()}
    assert got[1] == ("stored", None, "superseded", 2, 2, "pending", "upsert", 2)
    assert got[2] == ("resolves", 1, "active", None, 1, "pending", "upsert", 1)
    assert got[4][0] == "duplicate" and got[4][2:7] == (None,) * 5
    assert got[5] == ("stored", None, "active", None, 1, "private", None, 0)
    log = sorted((r.memory_id, r.rev, r.note) for r in m.captured_revisions(done).collect())
    assert log == [(1, 1, "Written here"), (1, 2, "Replaced by a newer memory about P-1."), (2, 1, "Written here"), (5, 1, "Written here")]
    # Without flags all notes are shared, and an empty table gives no rows.
    plain = spark.createDataFrame(rows, SCHEMA).select("memory_id", "asset", "at", "embedding")
    assert {r.memory_id: r.outcome for r in m.outcomes(plain).collect()} == {1: "stored", 2: "updates", 3: "duplicate", 4: "duplicate", 5: "stored", 6: "duplicate"}
    assert m.capture(plain.limit(0)).collect() == []
