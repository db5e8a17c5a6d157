"""Rollups, retention, collapse, link state and other windows over the journal tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.plans.registry import query


@query("select device_id, count(*) as notes, count(*) filter (where scope = 'private') as private, count(*) filter (where scope = 'shared') as shared, count(*) filter (where scope = 'redacted') as redacted, count(*) filter (where sync_state = 'pending') as pending, count(*) filter (where sync_state = 'synced') as synced, count(*) filter (where sync_state = 'conflict') as conflict, count(*) filter (where sync_state = 'failed') as failed, count(*) filter (where review = 'pending') as waiting, count(*) filter (where review = 'rejected') as rejected, count(*) filter (where status = 'superseded') as superseded, count(*) filter (where shard = 'local') as local, count(*) filter (where shard = 'replica') as replica from notes group by device_id")
def memory_stats(t):
    def n(column, value, name=None):
        return F.count_if(F.col(column) == value).alias(name or value)

    counts = [n("scope", v) for v in ("private", "shared", "redacted")] + [n("sync_state", v) for v in ("pending", "synced", "conflict", "failed")]
    counts += [n("review", "pending", "waiting"), n("review", "rejected"), n("status", "superseded"), n("shard", "local"), n("shard", "replica")]
    return t.notes.groupBy("device_id").agg(F.count("*").alias("notes"), *counts)


@query("select " + ", ".join(f"count(*) filter (where state = '{s}') as {s}" for s in ("pending", "conflict", "failed", "done", "cancelled")) + " from outbox")
def outbox_counts(t):
    return t.outbox.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "conflict", "failed", "done", "cancelled")))


@query("select count(*) as runs, coalesce(sum(pushed), 0)::bigint as pushed, coalesce(sum(pulled), 0)::bigint as pulled, coalesce(sum(merged), 0)::bigint as merged, coalesce(sum(bytes_up), 0)::bigint as bytes_up from sync_runs where status = 'ok'")
def sync_totals(t):
    return t.sync_runs.where("status = 'ok'").agg(F.count("*").alias("runs"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("pushed", "pulled", "merged", "bytes_up")))


@query("""with r as (select device_id, value, row_number() over (partition by device_id order by id desc) as age from activity),
k as (select device_id, value, row_number() over (partition by device_id order by value) - 1 as i, count(*) over (partition by device_id) as n from r where age <= 500)
select device_id, n, max(value) filter (where i = least(n - 1, round_even(0.5 * (n - 1), 0)::bigint)) as p50, max(value) filter (where i = least(n - 1, round_even(0.95 * (n - 1), 0)::bigint)) as p95 from k group by device_id, n""")
def latency_quantiles(t):
    """Nearest rank, half to even, over each device's last 500 measurements."""
    recent = t.activity.withColumn("age", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("id")))).where("age <= 500")
    by_value = Window.partitionBy("device_id")
    k = recent.select("device_id", "value", (F.row_number().over(by_value.orderBy("value")) - 1).alias("i"), F.count("*").over(by_value).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.bround(q * (F.col("n") - 1)).cast("long")), F.col("value")))
    return k.groupBy("device_id", "n").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("select device_id, category, count(*) as n, category || ' (' || count(*) || ')' as header from local_notes where status = 'active' group by device_id, category")
def report_groups(t):
    n = F.count("*")
    return t.local_notes.where("status = 'active'").groupBy("device_id", "category").agg(n.alias("n"), F.concat(F.first("category"), F.lit(" ("), n, F.lit(")")).alias("header"))


@query("select device_id, greatest(max(updated_at), timestamp '1999-01-01') as cursor from cloud_notes group by device_id")
def pull_cursor(t):
    return t.cloud_notes.groupBy("device_id").agg(F.greatest(F.max("updated_at"), F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).alias("cursor"))


@query("select count(*) filter (where status <> 'deleted') as live, count(*) filter (where status = 'deleted') as tombstones from cloud_notes")
def cloud_totals(t):
    return t.cloud_notes.agg(F.count_if(F.col("status") != "deleted").alias("live"), F.count_if(F.col("status") == "deleted").alias("tombstones"))


# How a run is told in words.
_PARTS = {"pushed": "sent {}", "pulled": "received {}", "merged": "merged {}", "removed": "removed {}", "conflicts": "{} need a decision", "failed": "{} set aside after repeated failures"}
_IDLE, _DONE = "Sync complete, already up to date.", "Sync complete: {}."


def _told(name, words):
    before, after = words.split("{}")
    return f"case when {name} > 0 then '{before}' || {name} || '{after}' end"


_LISTED = "array_to_string(list_filter([" + ", ".join(_told(k, v) for k, v in _PARTS.items()) + "], lambda y: y is not null), ', ')"


@query(f"select run_id, status, pushed, pulled, removed, merged, conflicts, failed, bytes_up + bytes_down as bytes, case when {_LISTED} = '' then '{_IDLE}' else 'Sync complete: ' || {_LISTED} || '.' end as summary from sync_runs")
def run_summary(t):
    parts = F.array_compact(F.array(*(F.when(F.col(k) > 0, F.format_string(v.replace("{}", "%s"), F.col(k))) for k, v in _PARTS.items())))
    told = F.when(F.size(parts) == 0, _IDLE).otherwise(F.format_string(_DONE.replace("{}", "%s"), F.array_join(parts, ", ")))
    return t.sync_runs.select("run_id", "status", "pushed", "pulled", "removed", "merged", "conflicts", "failed", (F.col("bytes_up") + F.col("bytes_down")).alias("bytes"), told.alias("summary"))


@query("""with s as (select *, sum(case when approved then 0 else 1 end) over (partition by device_id order by decision_id) as island from reviews)
select decision_id, device_id, sum(case when approved then 1 else 0 end) over (partition by device_id, island order by decision_id)::bigint as streak, sum(case when approved then 1 else 0 end) over (partition by device_id, island order by decision_id) >= 10 as trusted from s""")
def approval_streak(t):
    order = Window.partitionBy("device_id").orderBy("decision_id")
    s = t.reviews.withColumn("island", F.sum(F.when(F.col("approved"), 0).otherwise(1)).over(order))
    streak = F.sum(F.col("approved").cast("long")).over(Window.partitionBy("device_id", "island").orderBy("decision_id"))
    return s.select("decision_id", "device_id", streak.alias("streak"), (streak >= 10).alias("trusted"))


@query("select run_id, status from sync_runs where not (run_trigger = 'auto' and pushed + pulled + merged = 0 and waiting = 0) and status <> 'running'")
def run_lifecycle(t):
    idle = (F.col("run_trigger") == "auto") & (F.col("pushed") + F.col("pulled") + F.col("merged") == 0) & (F.col("waiting") == 0)
    return t.sync_runs.where(~idle & (F.col("status") != "running")).select("run_id", "status")


@query("select device_id, max(started_at) as last_seen, arg_max(pulled, run_id)::bigint as received from sync_runs where pulled > 0 group by device_id")
def peer_last_seen(t):
    return t.sync_runs.where("pulled > 0").groupBy("device_id").agg(F.max("started_at").alias("last_seen"), F.max_by("pulled", "run_id").cast("long").alias("received"))


@query("select label % 5 as device, count(*) as learned from embeddings group by 1")
def learned_count(t):
    return t.embeddings.groupBy((F.col("label") % 5).alias("device")).agg(F.count("*").alias("learned"))


#: Rows of each journal that a device keeps; an open outbox entry is never pruned.
KEPT = {"events": 20_000, "runs": 2_000, "closed": 5_000}


def _newest(source, key, n, where="true"):
    return f"select '{source}' as journal, {key} as id, device_id from (select {key}, device_id, row_number() over (partition by device_id order by {key} desc) as n from {source} where {where}) where n <= {n}"


_CLOSED = "state in ('done', 'cancelled')"


@query(" union all ".join([_newest("activity", "id", KEPT["events"]), _newest("sync_runs", "run_id", KEPT["runs"]), _newest("outbox", "seq", KEPT["closed"], _CLOSED), f"select 'outbox', seq, device_id from outbox where not {_CLOSED}"]))
def retention(t):
    return retained(t.activity, t.sync_runs, t.outbox, KEPT)


def retained(activity, runs, outbox, kept):
    """(journal, id, device_id) of the newest rows of each journal and of all open outbox entries."""

    def newest(df, name, key, n):
        place = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc(key)))
        return df.withColumn("n", place).where(F.col("n") <= n).select(F.lit(name).alias("journal"), F.col(key).alias("id"), "device_id")

    still = outbox.where(f"not {_CLOSED}").select(F.lit("outbox").alias("journal"), F.col("seq").alias("id"), "device_id")
    return newest(activity, "activity", "id", kept["events"]).unionByName(newest(runs, "sync_runs", "run_id", kept["runs"])).unionByName(newest(outbox.where(_CLOSED), "outbox", "seq", kept["closed"])).unionByName(still)


_ORDER = "ts, line, part, supp, quantity"


@query(f"select memory_id, n as age, flags from (select *, row_number() over (partition by memory_id order by ts desc, line desc, part desc, supp desc, quantity desc) as n from revisions) where n <= 3")
def revision_retention(t):
    order = Window.partitionBy("memory_id").orderBy(*(F.desc(c) for c in _ORDER.split(", ")))
    return t.revisions.withColumn("age", F.row_number().over(order)).where("age <= 3").select("memory_id", "age", "flags")


@query(f"select memory_id, n, flags, quantity from (select *, row_number() over w as n, lag(flags) over w as before, lag(ts) over w as before_ts from revisions window w as (partition by memory_id order by {_ORDER})) where n = 1 or before is distinct from flags or before_ts <> ts")
def revision_log(t):
    order = Window.partitionBy("memory_id").orderBy(*_ORDER.split(", "))
    r = t.revisions.withColumns({"n": F.row_number().over(order), "last": F.lag(F.struct("flags", "ts")).over(order)})
    return r.where("n = 1 or not (last <=> struct(flags, ts))").select("memory_id", "n", "flags", "quantity")


@query(f"select memory_id, row_number() over (partition by memory_id order by {_ORDER}) as rev, strftime(ts, '%Y-%m-%d') || ' ' || flags as line from revisions")
def revision_list(t):
    order = Window.partitionBy("memory_id").orderBy(*_ORDER.split(", "))
    return t.revisions.select("memory_id", F.row_number().over(order).alias("rev"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" "), "flags").alias("line"))


@query("""with c as (select *, coalesce(sum(case when state in ('done', 'cancelled') then 1 else 0 end) over (partition by device_id, memory_id order by seq rows between unbounded preceding and 1 preceding), 0) as island from outbox)
select device_id, memory_id, min(seq) as seq, arg_min(base_rev, seq) as base_rev, arg_max(op, seq) as op, max(priority) as priority, arg_max(state, seq) as state, count(*) as edits from c group by device_id, memory_id, island""")
def outbox_collapse(t):
    """Edits up to a close are one entry: the first base, the last operation, the greatest priority."""
    before = Window.partitionBy("device_id", "memory_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = t.outbox.withColumn("island", F.coalesce(F.sum(F.col("state").isin("done", "cancelled").cast("int")).over(before), F.lit(0)))
    return c.groupBy("device_id", "memory_id", "island").agg(F.min("seq").alias("seq_"), F.min_by("base_rev", "seq").alias("base_rev"), F.max_by("op", "seq").alias("op"), F.max("priority").alias("priority"), F.max_by("state", "seq").alias("state"), F.count("*").alias("edits")).withColumnRenamed("seq_", "seq").drop("island")


@query("select seq, device_id, place from (select seq, device_id, row_number() over (partition by device_id order by value desc, seq) as place from outbox where state = 'pending') where place <= 20")
def topk_per_query(t):
    order = Window.partitionBy("device_id").orderBy(F.desc("value"), "seq")
    return t.outbox.where("state = 'pending'").select("seq", "device_id", F.row_number().over(order).alias("place")).where("place <= 20")


@query("""with f as (select *, case when lag(online) over (partition by device_id order by ts, id) is distinct from online then 1 else 0 end as flip from heartbeats),
s as (select *, sum(flip) over (partition by device_id order by ts, id) as span from f)
select device_id, span::bigint as span, online, min(ts) as since, max(ts) as until, count(*) as beats from s group by device_id, span, online""")
def link_spans(t):
    order = Window.partitionBy("device_id").orderBy("ts", "id")
    s = t.heartbeats.withColumn("flip", (~F.lag("online").over(order).eqNullSafe(F.col("online"))).cast("long")).withColumn("span", F.sum("flip").over(order))
    return s.groupBy("device_id", "span", "online").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("beats"))


@query("select id, device_id, (sum((value * 100)::bigint) over (partition by device_id order by id rows between 199 preceding and current row))::bigint as cents, max(value) over (partition by device_id order by id rows between 199 preceding and current row) as worst from activity")
def last_n_latency(t):
    w = Window.partitionBy("device_id").orderBy("id").rowsBetween(-199, 0)
    return t.activity.select("id", "device_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("cents"), F.max("value").over(w).alias("worst"))


@query("""with c as (select *, row_number() over (partition by device_id order by run_id) as cycle, lag(status) over (partition by device_id order by run_id) as before from sync_runs)
select run_id, cycle, case when cycle = 1 or cycle % 30 = 0 or before = 'failed' or run_trigger = 'manual' then 'full' else 'changes' end as mode from c""")
def pull_mode(t):
    order = Window.partitionBy("device_id").orderBy("run_id")
    c = t.sync_runs.select("run_id", "run_trigger", F.row_number().over(order).alias("cycle"), F.lag("status").over(order).alias("before"))
    full = (F.col("cycle") == 1) | (F.col("cycle") % 30 == 0) | F.coalesce(F.col("before") == "failed", F.lit(False)) | (F.col("run_trigger") == "manual")
    return c.select("run_id", "cycle", F.when(full, "full").otherwise("changes").alias("mode"))


@query("select memory_id, min(seq) as conflict_id, arg_max(op, seq) as op, max(seq) as last_seq from outbox where state = 'conflict' group by memory_id")
def one_open_conflict(t):
    return t.outbox.where("state = 'conflict'").groupBy("memory_id").agg(F.min("seq").alias("conflict_id"), F.max_by("op", "seq").alias("op"), F.max("seq").alias("last_seq"))


@query("select seq, device_id, place from (select seq, device_id, row_number() over (partition by device_id order by priority desc, seq) as place from outbox where state = 'pending') where place <= 25")
def drain_batch(t):
    order = Window.partitionBy("device_id").orderBy(F.desc("priority"), "seq")
    return t.outbox.where("state = 'pending'").select("seq", "device_id", F.row_number().over(order).alias("place")).where("place <= 25")
