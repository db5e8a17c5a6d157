"""Keyed state machines over many micro-batches against plain folds; restarts, timers and evicted state."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from notelake.operators import sync
from notelake.sources.scratch import scratch_path
from notelake.streaming import stateful, streams
from tests.test_capture import SCHEMA, made, walk


def write_batches(spark, path, rows, schema, cuts):
    """Files whose order is that of the rows: each is a micro-batch."""
    for n, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        df = spark.createDataFrame(rows[lo:hi], schema).coalesce(1)
        df.write.mode("append").parquet(f"{path}/in")
        new = [f for f in path.joinpath("in").glob("part-*") if not f.name.startswith("part-0-")]
        for f in new:  # names in order; the file source goes by time, then name
            f.rename(path / "in" / f"part-0-{n:04d}.parquet")
        time.sleep(0.02)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def cuts(n, parts, seed):
    return sorted(random.Random(seed).sample(range(1, n), parts - 1))


@pytest.mark.parametrize("parts", [1, 4, 20])
def test_capture(spark, tmp_path, parts):
    rows = sorted(made(60, parts), key=lambda r: (r[2], r[0]))
    feed = write_batches(spark, tmp_path, rows, SCHEMA, cuts(60, parts, 1))
    got = {r.memory_id: (r.outcome, r.other) for r in streams.run_to_end(stateful.capture(feed, 0.97, 0.8)).collect()}
    assert got == walk(rows, 0.97, 0.8)


def test_capture_after_what_was_replaced_is_gone(spark, tmp_path):
    """B replaces A; then E is a copy of D, which B is alike to, and stays a duplicate of D."""
    d, b = [1.0, 0.0, 0.0], [0.85, 0.52678, 0.0]
    a, e = [0.60, 0.75, 0.28], [0.9998, 0.02, 0.0]
    rows = [(i, "x", i, v, "shared", "observation", "t", 0) for i, v in enumerate((d, a, b, e))]
    feed = write_batches(spark, tmp_path, rows, SCHEMA, [3])
    got = {r.memory_id: (r.outcome, r.other) for r in streams.run_to_end(stateful.capture(feed, 0.97, 0.87)).collect()}
    assert got == walk(rows, 0.97, 0.87) == {0: ("stored", None), 1: ("stored", None), 2: ("updates", 1), 3: ("duplicate", 0)}


ACTIONS = "device_id string, memory_id long, seq long, action string, op string, priority int, base_rev int"


def entries(rows):
    """The last entry of each note."""
    out = {}
    for device, note, seq, action, op, priority, base in rows:
        e = out.get((device, note))
        live = e is not None and e["state"] in ("pending", "conflict", "failed")
        if action == "enqueue" and not live:
            e = out[device, note] = {"seq": seq, "op": op, "priority": priority, "base_rev": base, "state": "pending", "attempts": 0, "closed": e["closed"] if e else 0}
        elif action == "enqueue":
            e |= {"op": op, "priority": max(e["priority"], priority), "state": "pending", "attempts": 0}
        elif live and action == "cancel":
            e |= {"state": "cancelled", "closed": e["closed"] + 1}
        elif live and action == "retry" and e["state"] == "failed":
            e |= {"state": "pending", "attempts": 0}
        elif live and action == "rebase" and e["state"] != "failed":
            e |= {"state": "pending", "base_rev": base}
        elif live and e["state"] == "pending" and action in ("fail", "done", "conflict"):
            e["attempts"] += 1
            if action != "fail":
                e |= {"state": action, "closed": e["closed"] + (action == "done")}
            elif e["attempts"] == 5:
                e |= {"state": "failed", "attempts": 6}
    return {k: tuple(v.values()) for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_outbox(spark, tmp_path, parts):
    rnd = random.Random(parts)
    rows = [(f"d{rnd.randrange(2)}", rnd.randrange(3), i, rnd.choice(["enqueue", "fail", "fail", "fail", "fail", "fail", "defer", "done", "conflict", "rebase", "retry", "cancel"]), rnd.choice(["upsert", "delete"]), rnd.randrange(3), rnd.randrange(9)) for i in range(240)]
    rows = [("d0", 7, -1, "done", "upsert", 0, 0), *rows]
    feed = write_batches(spark, tmp_path, rows, ACTIONS, cuts(len(rows), parts, 2))
    out = streams.run_to_end(stateful.outbox(feed), "update").toPandas().sort_values("batch").groupby(["device_id", "memory_id"]).tail(1)
    got = {(r.device_id, r.memory_id): (r.seq, r.op, r.priority, r.base_rev, r.state, r.attempts, r.closed) for r in out.itertuples()}
    want = entries(rows)
    assert got == want and ("d0", 7) not in got


def test_an_entry_is_set_aside_at_the_fifth_failure_and_retried(spark, tmp_path):
    say = lambda *actions: [("d", 1, i, a, "upsert", 1, 0) for i, a in enumerate(actions)]
    rows = say("enqueue", "fail", "defer", "fail", "fail", "fail", "fail", "done", "retry", "fail")
    out = streams.run_to_end(stateful.outbox(write_batches(spark, tmp_path, rows, ACTIONS, list(range(1, len(rows))))), "update").orderBy("batch").collect()
    assert [(r.state, r.attempts) for r in out] == [("pending", 0), ("pending", 1), ("pending", 1), ("pending", 2), ("pending", 3), ("pending", 4), ("failed", 6), ("failed", 6), ("pending", 0), ("pending", 1)]


def test_link_spans(spark, tmp_path):
    rnd, at = random.Random(3), pd.Timestamp("2024-01-01")
    rows = [(f"d{rnd.randrange(3)}", i, (at + pd.Timedelta(minutes=i)).to_pydatetime(), rnd.random() < 0.7) for i in range(90)]
    feed = write_batches(spark, tmp_path, rows, "device_id string, id long, ts timestamp, online boolean", cuts(90, 11, 4))
    out = streams.run_to_end(stateful.link_spans(feed), "update").toPandas().sort_values("batch").groupby(["device_id", "span"]).tail(1)
    want = []
    for device in {r[0] for r in rows}:
        span, last = 0, None
        for _, _, ts, online in (r for r in rows if r[0] == device):
            if online != last:
                span, last = span + 1, online
                want.append([device, span, online, ts, ts, 0])
            want[-1][4:] = [ts, want[-1][5] + 1]
    got = [(r.device_id, r.span, r.online, r.since.to_pydatetime(), r.until.to_pydatetime(), r.beats) for r in out.itertuples()]
    assert sorted(got) == sorted(map(tuple, want)) and any(not w[2] for w in want)


WRITES = "memory_id long, seq long, kind string, expect_rev int, rev int, payload string"


def test_guarded_writes(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.randrange(4), i, rnd.choice(["write", "write", "patch", "tombstone"]), rnd.choice([None, 1, 2, 3]), rnd.randrange(1, 4), "p") for i in range(120)]
    feed = write_batches(spark, tmp_path, rows, WRITES, cuts(120, 9, 6))
    got = sorted(map(tuple, streams.run_to_end(stateful.guarded_writes(feed)).collect()))
    assert got == sorted(map(tuple, sync.guarded_writes(spark.createDataFrame(rows, WRITES)).collect()))


def test_a_patch_needs_its_row(spark):
    rows = [(1, 1, "patch", None, 1, "p"), (1, 2, "patch", 0, 1, "p"), (1, 3, "write", 5, 6, "p"), (1, 4, "patch", None, 7, "p"), (1, 5, "patch", 5, 7, "p"), (1, 6, "patch", 6, 7, "p"), (1, 7, "tombstone", 7, 8, "p"), (1, 8, "write", 7, 9, "p")]
    got = [r.landed for r in sync.guarded_writes(spark.createDataFrame(rows, WRITES)).orderBy("seq").collect()]
    assert got == [False, False, True, False, False, True, True, False]


def test_expiry_needs_no_further_row(spark, tmp_path):
    now = time.time()
    rows = [(1, now, now - 60), (2, now, now + 12), (3, now, now + 3600), (4, now, now + 3600), (4, now + 1, now - 5), (5, now, None)]
    rows = [tuple(None if v is None else pd.Timestamp(v, unit="s").floor("us").to_pydatetime() if k else v for k, v in enumerate(r)) for r in rows]
    feed = write_batches(spark, tmp_path, rows, "memory_id long, updated_at timestamp, expires_at timestamp", [4])
    told = lambda: {r.memory_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} if (tmp_path / "out").exists() and list((tmp_path / "out").glob("part*")) else set()
    seen = []
    out = streams.run_by_clock(stateful.expiry(feed), f"{tmp_path}/out", until=lambda: bool(seen.append(told()) or 2 in seen[-1] or time.time() > now + 60))
    ends = {r.memory_id: r.expired_at.timestamp() for r in out.collect()}
    assert ends.keys() == {1, 2, 4} and abs(ends[2] - (now + 12)) < 0.01
    assert time.time() >= now + 12


def test_an_urgent_entry_overtakes_and_nothing_is_lost_over_a_restart(spark, tmp_path):
    schema = "device_id string, seq long, priority int"
    rows = [("d", i, 0) for i in range(6)] + [("d", 9, 2), ("e", 10, 0)]
    write_batches(spark, tmp_path, rows, schema, [6, 7])
    out = scratch_path(spark, "drain")

    def run(stop_at=None):
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        step = streams.drain(feed, out, 2)

        def body(batch, n):
            step(batch, n)
            if n == stop_at:
                raise RuntimeError("the driver is lost")  # after its writes, before its commit

        return feed.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(body).start()

    with pytest.raises(Exception, match="lost"):
        run(1).awaitTermination()
    run().awaitTermination()
    sent = {b: [r.seq for r in rows] for b, rows in ((b, streams.drained(spark, out).where(F.col("batch") == b).orderBy("device_id", "place").collect()) for b in range(3))}
    assert sent == {0: [0, 1], 1: [9, 2], 2: [3, 4, 10]}
    assert [r.seq for r in spark.read.parquet(f"{out}/waiting/2").collect()] == [5]


def test_pulled_changes_are_evicted_and_redelivered_ones_dropped(spark, tmp_path):
    at = pd.Timestamp("2024-01-01")
    rows = [(i, 1, (at + pd.Timedelta(minutes=10 * i)).to_pydatetime()) for i in range(40)]
    twice = [x for k in range(0, 40, 4) for x in rows[k : k + 4] * 2] + [(99, 1, at.to_pydatetime())]
    feed = write_batches(spark, tmp_path, twice, "memory_id long, rev int, updated_at timestamp", list(range(8, 81, 8)))
    streams.keep_state_on_disk(spark)
    q = streams.pull_changes(feed, "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = [r.memory_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == list(range(40))  # the row that is far too late is left to the full listing
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 16
