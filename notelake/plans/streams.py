"""Streaming queries, run to the end of what is there, and their batch twins."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.plans.registry import ORACLES, query
from notelake.sources.scratch import scratch_path
from notelake.sources.tables import TABLES
from notelake.streaming import stateful as machines
from notelake.streaming import streams as st


def _exprs(name: str, time: str | None) -> list[str]:
    """The expressions of a logical table, with its time as a timestamp."""
    out = list(TABLES[name][1])
    return [f"cast({e.removesuffix(f' as {time}')} as timestamp) as {time}" if time and (e == time or e.endswith(f" as {time}")) else e for e in out]


@query("select distinct memory_id, rev from cloud_notes where bucket <> 3")
def stream_pull(t):
    """The change feed delivered twice; each revision arrives once. A note's time of change follows its number, as rows arrive."""
    exprs = ["o_orderkey as memory_id", "cast(o_orderkey % 7 + o_orderkey % 3 as int) as rev", "timestamp_seconds(1700000000 + o_orderkey) as updated_at", "explode(array(1, 2)) as delivery"]
    feed = st.stream_table(t.spark, t.sf_dir, "orders", exprs).where("memory_id % 10 <> 3")
    return st.run_to_end(st.pull_changes(feed, "1 hour")).select("memory_id", "rev")


@query("select memory_id, case when c.memory_id is null then 'gone' else 'held' end as found from replica_notes r left join cloud_notes c using (memory_id)")
def full_listing(t):
    """The complete comparison, which alone may call a row gone."""
    known = t.cloud_notes.select("memory_id", F.lit(True).alias("known"))
    return t.replica_notes.join(known, "memory_id", "left").select("memory_id", F.when(F.col("known").isNull(), "gone").otherwise("held").alias("found"))


@query("select device_id, streak, decisions, streak >= 10 as trusted from (select device_id, count(*) as decisions, count(*) filter (where approved and decision_id > coalesce(last_no, -1)) as streak from (select *, max(case when not approved then decision_id end) over (partition by device_id) as last_no from reviews) group by device_id)")
def stream_trust(t):
    feed = st.stream_table(t.spark, t.sf_dir, "labels", TABLES["reviews"][1])
    out = st.run_to_end(st.trust(feed), "update")
    newest = out.withColumn("n", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("batch"), F.desc("decisions")))).where("n = 1")
    return newest.select("device_id", "streak", "decisions", "trusted")


def _newest(out, *keys):
    """The newest row of each key of what a stream has updated."""
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("n = 1").drop("n", "batch")


#: What is done with a device's notes, in the order of seq.
_ACTIONS = [
    "event_id as seq", "concat('d', cast(user_id % 20 as string)) as device_id", "user_id * 7 % 300 as memory_id", "case when event_id % 11 = 0 then 'done' when event_id % 11 = 1 then 'conflict' when event_id % 11 in (2, 3, 4) then 'fail' when event_id % 11 = 5 then 'cancel' when event_id % 11 = 6 then 'retry' when event_id % 11 = 7 then 'rebase' when event_id % 11 = 8 then 'defer' else 'enqueue' end as action",
    "case event_type when 'error' then 'delete' when 'purchase' then 'retract' else 'upsert' end as op", "cast(event_id % 3 as int) as priority", "cast(event_id % 5 as int) as base_rev",
]
_OPEN = "s.state in ('pending', 'conflict', 'failed')"
_ENTRY = "struct_pack(seq := {}, action := {}, op := {}, priority := {}, base_rev := {}, state := {}, attempts := {}, closed := {})"
_NEXT = f"""case when x.action = 'enqueue' then 'pending' when x.action = 'fail' and s.state = 'pending' then case when s.attempts >= 4 then 'failed' else 'pending' end when x.action in ('done', 'conflict') and s.state = 'pending' then x.action
  when x.action = 'rebase' and s.state in ('pending', 'conflict') then 'pending' when x.action = 'retry' and s.state = 'failed' then 'pending' when x.action = 'cancel' and {_OPEN} then 'cancelled' else s.state end"""
_TRIES = """case when x.action = 'enqueue' then 0 when x.action = 'fail' and s.state = 'pending' then case when s.attempts >= 4 then s.attempts + 2 else s.attempts + 1 end when x.action in ('done', 'conflict') and s.state = 'pending' then s.attempts + 1
  when x.action = 'retry' and s.state = 'failed' then 0 else s.attempts end"""
_FRESH = f"x.action = 'enqueue' and not coalesce({_OPEN}, false)"
_OUTBOX = f"""with a as (select {', '.join(_ACTIONS)} from events),
l as (select device_id, memory_id, list({_ENTRY.format('seq', 'action', 'op', 'priority', 'base_rev', 'null::varchar', '0', '0::bigint')} order by seq) as xs from a group by device_id, memory_id),
f as (select device_id, memory_id, list_reduce(list_prepend({_ENTRY.format('null::bigint', "''", 'null::varchar', 'null::int', 'null::int', 'null::varchar', '0', '0::bigint')}, xs), lambda s, x: {_ENTRY.format(f'case when {_FRESH} then x.seq else s.seq end', "''", "case when x.action = 'enqueue' then x.op else s.op end", f"case when {_FRESH} then x.priority when x.action = 'enqueue' then greatest(s.priority, x.priority) else s.priority end", f"case when {_FRESH} then x.base_rev when x.action = 'rebase' and s.state in ('pending', 'conflict') then x.base_rev else s.base_rev end", _NEXT, _TRIES, f"s.closed + case when coalesce({_OPEN}, false) and (x.action = 'cancel' or (x.action = 'done' and s.state = 'pending')) then 1 else 0 end")}) as e from l)
select device_id, memory_id, e.seq as seq, e.op as op, e.priority as priority, e.base_rev as base_rev, e.state as state, e.attempts as attempts, e.closed as closed from f where e.state is not null"""


@query(_OUTBOX)
def stream_outbox(t):
    """The life of each note's entry in a device's queue."""
    feed = st.stream_table(t.spark, t.sf_dir, "events", _ACTIONS)
    return _newest(st.run_to_end(machines.outbox(feed), "update"), "device_id", "memory_id")


@query()
def stream_link(t):
    """The spans of ``link_spans`` as the beats arrive."""
    feed = st.stream_table(t.spark, t.sf_dir, "events", TABLES["heartbeats"][1])
    return _newest(st.run_to_end(machines.link_spans(feed.withColumn("ts", F.col("ts").cast("timestamp"))), "update"), "device_id", "span").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


@query("select o_orderkey as memory_id, o_orderdate + interval '3' day as expired_at from orders where o_orderkey is not null")
def stream_expiry(t):
    """Announcements whose time is up by now; every order is one."""
    exprs = ["o_orderkey as memory_id", "o_orderdate as updated_at", "cast(o_orderdate as timestamp) + interval '3' day as expires_at"]
    feed = st.stream_table(t.spark, t.sf_dir, "orders", exprs)
    return st.run_by_clock(machines.expiry(feed), scratch_path(t.spark, "expiry")).withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz"))


@query()
def stream_capture(t):
    feed = st.stream_table(t.spark, t.sf_dir, "embeddings", ["vec_id as memory_id", "label as asset", "vec_id as at", "embedding"])
    return st.run_to_end(machines.capture(feed, same=0.5, follows=0.35))


@query()
def stream_cas(t):
    """``cas_apply`` as the writes arrive."""
    exprs = ["user_id * 7 % 300 as memory_id", "event_id as seq", "case when event_id % 6 = 0 then 'patch' when event_id % 6 = 1 then 'tombstone' else 'write' end as kind", "case when event_id % 5 <> 0 then cast(user_id % 5 as int) end as expect_rev", "cast(user_id % 5 + 1 as int) as rev", "event_type"]
    feed = st.stream_table(t.spark, t.sf_dir, "events", exprs).where("event_type in ('view', 'click')").withColumnRenamed("event_type", "payload")
    return st.run_to_end(machines.guarded_writes(feed))


@query("select seq, device_id, place from (select seq, device_id, row_number() over (partition by device_id order by priority desc, seq) as place from outbox where state = 'pending') where place <= 5")
def urgent_first(t):
    """What a micro-batch sends first when its size is limited; the others wait for the next."""
    feed = st.stream_table(t.spark, t.sf_dir, "events", [e for e in TABLES["outbox"][1] if not e.startswith("ts ")]).where("state = 'pending'").select("device_id", "seq", "priority")
    out = scratch_path(t.spark, "drain")
    feed.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(st.drain(feed, out, 5)).start().awaitTermination()
    return st.drained(t.spark, out).select("seq", "device_id", "place")


#: A stream run to its end has the rows of its batch twin.
ORACLES.update(stream_link=ORACLES["link_spans"], stream_cas=ORACLES["cas_apply"])
