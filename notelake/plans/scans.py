"""Sources, sinks, filters, sorts and set operations."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.operators import filters as f
from notelake.operators import sync
from notelake.plans.registry import query

NOW = "1998-06-01 00:00:00"
_CLOUD = ", ".join(f.CLOUD_FIELDS)


@query("select memory_id, kind, priority from notes where site = 's1' and status = 'active'")
def scan_notes(t):
    return t.notes.where("site = 's1' and status = 'active'").select("memory_id", "kind", "priority")


_BOTH = "(select *, 0 as place from local_notes union all by name select *, 1 as place from replica_notes)"


@query(f"select memory_id, rev, place from (select *, row_number() over (partition by memory_id order by place) as n from {_BOTH}) where n = 1")
def find_note(t):
    both = t.local_notes.withColumn("place", F.lit(0)).unionByName(t.replica_notes.withColumn("place", F.lit(1)))
    return f.latest(both, ["memory_id"], "place").select("memory_id", "rev", "place")


_MANIFEST = "memory_id, rev, status, device_id, review, priority, reviewed_by, reviewed_at, review_reason, updated_at"


@query(f"select {_MANIFEST} from cloud_notes where site in ('s2', 'global')")
def site_manifest(t):
    return t.cloud_notes.where(f.in_site("s2")).select(*_MANIFEST.split(", "))


@query(f"select {_MANIFEST} from cloud_notes where site in ('s2', 'global') and updated_at >= timestamp '1999-01-01' - interval '300' second")
def change_log(t):
    since = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz") - F.expr("interval '300' second")
    return t.cloud_notes.where(f.in_site("s2") & (F.col("updated_at") >= since)).select(*_MANIFEST.split(", "))


@query("select memory_id, text, rev from cloud_notes where memory_id in (select memory_id from outbox where op = 'upsert')")
def multi_get(t):
    return t.cloud_notes.join(t.outbox.where("op = 'upsert'").select("memory_id"), "memory_id", "left_semi").select("memory_id", "text", "rev")


@query("select memory_id, status = 'deleted' as gone, updated_at, row_number() over (order by updated_at desc, memory_id) as place from (select * from cloud_notes order by memory_id limit 200)")
def browse_cloud(t):
    first = t.cloud_notes.orderBy("memory_id").limit(200)  # the feature is a page of 200 rows
    return first.select("memory_id", (F.col("status") == "deleted").alias("gone"), "updated_at", F.row_number().over(Window.orderBy(F.desc("updated_at"), "memory_id")).alias("place"))


@query("select (select count(*) from cloud_notes where status <> 'deleted') as live_notes, (select count(*) from media where status <> 'deleted') as live_media")
def count_live(t):
    kinds = t.cloud_notes.select(F.lit("n").alias("k"), "status").unionByName(t.media.select(F.lit("m").alias("k"), "status")).where("status <> 'deleted'")
    return kinds.agg(F.count_if(F.col("k") == "n").alias("live_notes"), F.count_if(F.col("k") == "m").alias("live_media"))


@query("select photo_id, status, memory_id, device_id from media where site in ('s1', 'global')")
def media_manifest(t):
    return t.media.where(f.in_site("s1")).select("photo_id", "status", "memory_id", "device_id")


@query("select memory_id, rev from cloud_notes where status <> 'deleted' and site in ('s1', 'global') and memory_id not in (select memory_id from local_notes) and (review is distinct from 'pending' or priority >= 2)")
def snapshot_restore(t):
    kept = t.cloud_notes.where((F.col("status") != "deleted") & f.in_site("s1")).join(t.local_notes.select("memory_id"), "memory_id", "left_anti")
    return kept.where(f.may_see()).select("memory_id", "rev")


@query("select memory_id, rev, text from (select *, row_number() over (partition by memory_id order by place) as n from (select *, 0 as place from cloud_notes where bucket < 6 union all by name select *, 1 as place from replica_notes)) where n = 1 and memory_id not in (select memory_id from outbox where op = 'delete')")
def upsert_notes(t):
    written = t.cloud_notes.where("bucket < 6").withColumn("place", F.lit(0)).unionByName(t.replica_notes.withColumn("place", F.lit(1)))
    deleted = t.outbox.where("op = 'delete'").select("memory_id")
    return f.latest(written, ["memory_id"], "place").join(deleted, "memory_id", "left_anti").select("memory_id", "rev", "text")


@query("""select id, device_id, '{"id":' || id || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","type":"' || type || '","level":"' || level || '","message":"' || message || '","device":"' || device_id || '"}' as line from activity""")
def audit_export(t):
    line = F.to_json(F.struct("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "type", "level", "message", F.col("device_id").alias("device")))
    return t.activity.select("id", "device_id", line.alias("line"))


_RANK = "case category when 'safety_hazard' then 0 when 'equipment_fault' then 1 when 'routine_reading' then 2 when 'procedure_fix' then 3 when 'people_hr' then 4 when 'personal_health' then 5 else 6 end"


@query(f"select device_id, memory_id, category, row_number() over (partition by device_id order by {_RANK}, priority desc, updated_at, memory_id) as place, '- [' || strftime(updated_at, '%H:%M') || '] ' || text as line from local_notes where status = 'active' and scope <> 'private' and updated_at >= timestamp '{NOW}' - interval '2000' hour")
def shift_report(t):
    rows = t.local_notes.where("status = 'active' and scope <> 'private'").where(F.col("updated_at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval '2000' hour"))
    place = F.row_number().over(Window.partitionBy("device_id").orderBy(F.expr(_RANK), F.desc("priority"), "updated_at", "memory_id"))
    return rows.select("device_id", "memory_id", "category", place.alias("place"), F.concat(F.lit("- ["), F.date_format("updated_at", "HH:mm"), F.lit("] "), "text").alias("line"))


# The numbers that a device reports, by the table that they come from.
_GAUGES = {
    "notes": {"memories_local": "shard = 'local'", "memories_replica": "shard = 'replica'", "memories_private": "sync_state = 'private'", "memories_conflict": "sync_state = 'conflict'", "memories_failed": "sync_state = 'failed'"},
    "outbox": {"outbox_pending": "state = 'pending'", "outbox_failed": "state = 'failed'", "open_conflicts": "state = 'conflict'"},
}
_TOTALS = {"sync_runs_total": "1", "sync_pushed_total": "pushed", "sync_pulled_total": "pulled", "sync_merged_total": "merged", "sync_conflicts_total": "conflicts", "sync_bytes_up_total": "bytes_up", "sync_bytes_down_total": "bytes_down"}


def _long(source: str, values: dict[str, str], where: str = "true") -> str:
    return f"select device_id, unnest({list(values)}) as metric, unnest([{', '.join(f'({v})::double' for v in values.values())}]) as value from {source} where {where} group by device_id"


_METRICS = [_long(name, {k: f"count(*) filter (where {c})" for k, c in own.items()}) for name, own in _GAUGES.items()]
_METRICS += [_long("sync_runs", {k: f"sum({c})" for k, c in _TOTALS.items()} | {"last_sync_timestamp_seconds": "floor(epoch(max(started_at)))"}, "status = 'ok'"), _long("heartbeats", {"link_online": "arg_max(case when online then 1 else 0 end, id)"})]


@query(" union all ".join(_METRICS))
def fleet_metrics(t):
    """Counts, queue depths and totals of each device in long form; no note text is in them."""

    def long(df, values):
        wide = df.groupBy("device_id").agg(*(v.cast("double").alias(k) for k, v in values.items()))
        return wide.unpivot("device_id", list(values), "metric", "value")

    parts = [long(getattr(t, name), {k: F.count_if(F.expr(c)) for k, c in own.items()}) for name, own in _GAUGES.items()]
    totals = {k: F.sum(F.expr(c)) for k, c in _TOTALS.items()} | {"last_sync_timestamp_seconds": F.max(F.unix_timestamp(F.col("started_at").cast("timestamp")))}
    parts += [long(t.sync_runs.where("status = 'ok'"), totals), long(t.heartbeats, {"link_online": F.max_by(F.col("online").cast("int"), "id")})]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_PAYLOADS = ("base_payload", "local_payload", "cloud_payload")


@query("select id, (data->>'k')::bigint as k, " + ", ".join(f"{p}->>'text' as {p}_text, ({p}->>'rev')::int as {p}_rev" for p in _PAYLOADS) + ", array_to_string(from_json(fields, '[\"VARCHAR\"]'), ',') as fields from conflict_log")
def json_columns(t):
    payloads = [F.from_json(p, "text string, rev int") for p in _PAYLOADS]
    columns = [c for p, j in zip(_PAYLOADS, payloads, strict=True) for c in (j["text"].alias(f"{p}_text"), j["rev"].alias(f"{p}_rev"))]
    return t.conflict_log.select("id", F.from_json("data", "k bigint")["k"].alias("k"), *columns, F.array_join(F.from_json("fields", "array<string>"), ",").alias("fields"))


@query("select md5('manuals:' || p_partkey) as memory_id, p_name as text, 'reference' as kind, 'global' as site from part")
def publish_reference(t):
    made = t.part.select(F.md5(F.concat(F.lit("manuals:"), "p_partkey")).alias("memory_id"), F.col("p_name").alias("text"), F.lit("reference").alias("kind"), F.lit("global").alias("site"))
    return f.latest(made.unionByName(made), ["memory_id"], "text")  # publishing twice changes nothing


@query("select 'note' as part, memory_id as id from local_notes union all select 'example', vec_id from embeddings union all select 'outbox', seq from outbox where state in ('pending', 'failed')")
def bundle_export(t):
    parts = [t.local_notes.select(F.lit("note").alias("part"), F.col("memory_id").alias("id")), t.embeddings.select(F.lit("example").alias("part"), F.col("vec_id").alias("id")), t.outbox.where("state in ('pending', 'failed')").select(F.lit("outbox").alias("part"), F.col("seq").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with new as (select memory_id, sync_state in ('pending', 'failed') and scope <> 'private' as queued, priority, base_rev from cloud_notes where memory_id not in (select memory_id from local_notes)),
old as (select memory_id, arg_max(op, seq) as op, arg_max(base_rev, seq) as base_rev from outbox where state in ('pending', 'failed') group by memory_id)
select 'note' as part, memory_id as id, case when queued then 'pending' else 'kept' end as state, null as base_rev from new
union all select 'outbox', memory_id, coalesce(old.op, 'upsert'), coalesce(old.base_rev, new.base_rev) from new left join old using (memory_id) where queued
union all select 'example', id, 'learned', null from (select id from (select vec_id as id, 0 as fresh from embeddings where vec_id % 3 = 0 union all select vec_id, 1 from embeddings where vec_id % 2 = 0 and vec_id % 3 <> 0) order by fresh desc, id desc limit 200)""")
def bundle_import(t):
    """A bundle's notes that are not here yet, the outbox entries of those to be sent, and its learned examples behind the known ones, the last 200 of which stay (the feature)."""
    new = t.cloud_notes.join(t.local_notes.select("memory_id"), "memory_id", "left_anti").withColumn("queued", F.col("sync_state").isin("pending", "failed") & (F.col("scope") != "private"))
    old = t.outbox.where("state in ('pending', 'failed')").groupBy("memory_id").agg(F.max_by("op", "seq").alias("op"), F.max_by("base_rev", "seq").alias("op_rev"))
    none = F.lit(None).cast("int").alias("base_rev")
    notes = new.select(F.lit("note").alias("part"), F.col("memory_id").alias("id"), F.when(F.col("queued"), "pending").otherwise("kept").alias("state"), none)
    queued = new.where("queued").join(old, "memory_id", "left").select(F.lit("outbox").alias("part"), F.col("memory_id").alias("id"), F.coalesce("op", F.lit("upsert")).alias("state"), F.coalesce("op_rev", "base_rev").alias("base_rev"))
    known = t.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))
    fresh = t.embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id")).join(known, "id", "left_anti")
    kept = known.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1))).orderBy(F.desc("fresh"), F.desc("id")).limit(200)
    return notes.unionByName(queued).unionByName(kept.select(F.lit("example").alias("part"), "id", F.lit("learned").alias("state"), none))


@query("""select id, type, '{"value":' || (value * 100)::bigint || '}' as data from activity union all select run_id, 'sync', '{"value":' || pushed || '}' from sync_runs""")
def append_activity(t):
    rows = t.activity.select("id", "type", F.to_json(F.struct(F.round(F.col("value") * 100).cast("long").alias("value"))).alias("data"))
    return rows.unionByName(t.sync_runs.select(F.col("run_id").alias("id"), F.lit("sync").alias("type"), F.to_json(F.struct(F.col("pushed").alias("value"))).alias("data")))


@query("select memory_id from notes where site = 's1' and kind in ('observation', 'photo') and coalesce(review, '') <> 'pending' and coalesce(asset, '') not in ('P-1', 'P-2')")
def keyword_filter(t):
    return t.notes.where(f.keyword({"site": "s1", "kind": ["observation", "photo"], "scope": "", "asset": None, "category": []}, {"review": "pending", "asset": ["P-1", "P-2"]})).select("memory_id")


@query("select memory_id, kind = 'photo' and coalesce(review, '') <> 'pending' as passes from notes")
def row_filter(t):
    return t.notes.select("memory_id", f.keyword({"kind": "photo"}, {"review": "pending"}).alias("passes"))


@query(f"select memory_id, updated_at from notes where contains(lower(text), 'bearing') and status = 'active' and not coalesce(expires_at <= timestamp '{NOW}', false)")
def list_notes(t):
    rows = t.notes.where(f.keyword({"status": "active"}) & F.contains(F.lower("text"), F.lower(F.lit("BEARING"))) & ~f.expired(NOW))
    return rows.select("memory_id", "updated_at").orderBy(F.desc("updated_at"), "memory_id")  # sorted over ranges, not in one task


@query(f"select memory_id, not coalesce(expires_at <= timestamp '{NOW}', false) as live from notes")
def not_expired(t):
    return t.notes.select("memory_id", (~f.expired(NOW)).alias("live"))


@query("select memory_id, review is distinct from 'pending' or priority >= 2 as for_all from notes")
def may_see(t):
    return t.notes.select("memory_id", f.may_see().alias("for_all"))


@query("select memory_id from notes where scope <> 'private' and not withdrawn and sync_state <> 'private'")
def shareable(t):
    return t.notes.where(f.shareable()).select("memory_id")


@query("select memory_id, site from notes where site in ('s3', 'global')")
def site_scope(t):
    return t.notes.where(f.in_site("s3")).select("memory_id", "site")


@query(f"select memory_id, {_CLOUD}, case when scope = 'redacted' then coalesce(nullif(shared_text, ''), text) else text end as text, scope = 'redacted' as redacted from notes")
def cloud_view(t):
    return f.cloud_view(t.notes)


@query("select memory_id, coalesce(nullif(priority, 0), 1) as priority, coalesce(rev, 1) as rev, coalesce(nullif(status, ''), 'active') as status, case when shard = 'local' then 'mine' when via_peer is not null then 'peer' else 'cloud' end as source, base_rev, device_id = 'd1' as mine from notes")
def present(t):
    source = F.when(F.col("shard") == "local", "mine").when(F.col("via_peer").isNotNull(), "peer").otherwise("cloud")
    return t.notes.select("memory_id", F.coalesce(F.nullif("priority", F.lit(0)), F.lit(1)).alias("priority"), F.coalesce("rev", F.lit(1)).alias("rev"), F.coalesce(f.blank(F.col("status")), F.lit("active")).alias("status"), source.alias("source"), "base_rev", (F.col("device_id") == "d1").alias("mine"))


@query("select memory_id, 'deleted' as status, '' as text, rev + 1 as rev, device_id, site, case when review = 'rejected' then 'rejected: ' || review_reason else 'deleted' end as tombstone from notes where status = 'deleted' or review = 'rejected'")
def tombstone_view(t):
    gone = t.notes.where("status = 'deleted' or review = 'rejected'")
    return f.tombstone(gone, F.when(F.col("review") == "rejected", F.concat(F.lit("rejected: "), "review_reason")).otherwise("deleted"))


@query("select m.photo_id, m.memory_id, m.width, m.height, m.faces, case when n.scope = 'redacted' then coalesce(nullif(n.shared_text, ''), n.text) else n.text end as caption from media m join notes n using (memory_id) where m.status = 'active'")
def media_view(t):
    notes = t.notes.select("memory_id", f.outgoing_text().alias("caption"))
    return t.media.where("status = 'active'").join(notes, "memory_id").select("photo_id", "memory_id", "width", "height", "faces", "caption")


@query("select memory_id, coalesce(try_cast(schema_text as int), 0) as version, coalesce(try_cast(schema_text as int), 0) > 1 as held, greatest(coalesce(try_cast(schema_text as int), 0), 1) as version_after from notes")
def schema_gate(t):
    return f.schema_gate(t.notes)


_CONTENT = ["text", "kind", "asset", "tag_text", "status", "supersedes", "superseded_by", "relation"]


@query("select memory_id, " + " and ".join(f"a.{c} is not distinct from b.{c}" for c in _CONTENT) + " as same from local_notes a join cloud_notes b using (memory_id)")
def same_content(t):
    return t.local_notes.alias("a").join(t.cloud_notes.alias("b"), "memory_id").select("memory_id", sync.same_content("a", "b").alias("same"))


@query("select memory_id, a.base_rev = b.rev and a.text = b.text and (a.scope = 'redacted') = (b.scope = 'redacted') and b.status <> 'deleted' as payload_only from local_notes a join cloud_notes b using (memory_id)")
def payload_only(t):
    ok = (F.col("a.base_rev") == F.col("b.rev")) & (F.col("a.text") == F.col("b.text")) & ((F.col("a.scope") == "redacted") == (F.col("b.scope") == "redacted")) & (F.col("b.status") != "deleted")
    return t.local_notes.alias("a").join(t.cloud_notes.alias("b"), "memory_id").select("memory_id", ok.alias("payload_only"))


@query("select memory_id, case when n.scope = 'private' then null when d.role = 'trainee' and not d.trusted then 'pending' when d.role = 'trainee' then 'approved' end as review, case when n.scope <> 'private' and d.role = 'trainee' and d.trusted then 'trusted' end as reviewed_by from notes n left join devices d using (device_id)")
def stamp_review(t):
    trainee, trusted, shared = F.col("d.role") == "trainee", F.col("d.trusted"), F.col("n.scope") != "private"
    review = F.when(shared & trainee & ~trusted, "pending").when(shared & trainee, "approved")
    return t.notes.alias("n").join(t.devices.alias("d"), "device_id", "left").select("memory_id", review.alias("review"), F.when(shared & trainee & trusted, "trusted").alias("reviewed_by"))


@query("select photo_id, round(score / 20, 4) as strength, score / 20 >= 0.2 as answers from media where score / 20 >= 0.05")
def score_floor(t):
    s = F.col("score") / 20
    return t.media.where(s >= 0.05).select("photo_id", F.round(s, 4).alias("strength"), (s >= 0.2).alias("answers"))


@query("select memory_id, shard from notes where shard in ('replica')")
def source_choice(t):
    return t.notes.where(F.col("shard").isin("replica")).select("memory_id", "shard")


@query(f"select memory_id, updated_at from notes where kind = 'announcement' and status = 'active' and scope <> 'private' and not coalesce(expires_at <= timestamp '{NOW}', false)")
def announcements(t):
    rows = t.notes.where(f.keyword({"kind": "announcement", "status": "active"}, {"scope": "private"}) & ~f.expired(NOW))
    return rows.select("memory_id", "updated_at").orderBy(F.desc("updated_at"), "memory_id")


@query("select l.memory_id, l.text, c.review, c.reviewed_by, c.reviewed_at, c.review_reason from local_notes l join (select * from cloud_notes) c using (memory_id)")
def copy_review(t):
    fields = ["review", "reviewed_by", "reviewed_at", "review_reason"]
    return t.local_notes.drop(*fields).select("memory_id", "text").join(t.cloud_notes.select("memory_id", *fields), "memory_id")


@query("select device_id, case when role in ('trainee', 'technician', 'supervisor') then role else 'technician' end as role, coalesce(trusted, false) as trusted, coalesce(streak, 0) as streak from devices")
def effective_role(t):
    return t.devices.select("device_id", F.when(F.col("role").isin("trainee", "technician", "supervisor"), F.col("role")).otherwise("technician").alias("role"), F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce("streak", F.lit(0)).alias("streak"))


@query("select seq, device_id, row_number() over (order by priority desc, seq) as place from outbox where state = 'pending' order by priority desc, seq limit 25")
def outbox_order(t):
    head = t.outbox.where("state = 'pending'").orderBy(F.desc("priority"), "seq").limit(25)  # a batch is the feature
    return head.select("seq", "device_id", F.row_number().over(Window.orderBy(F.desc("priority"), "seq")).alias("place"))


@query("select id, type, row_number() over (order by id) as place from (select * from activity where id > 100 order by id desc limit 200)")
def events_page(t):
    page = t.activity.where("id > 100").orderBy(F.desc("id")).limit(200)
    return page.select("id", "type", F.row_number().over(Window.orderBy("id")).alias("place"))


@query("select run_id, status, row_number() over (order by run_id desc) as place, (select max(run_id) from sync_runs where status = 'ok') as last_ok from sync_runs order by run_id desc limit 20")
def recent_runs(t):
    last = t.sync_runs.where("status = 'ok'").agg(F.max("run_id").alias("last_ok"))
    head = t.sync_runs.orderBy(F.desc("run_id")).limit(20)
    return head.select("run_id", "status", F.row_number().over(Window.orderBy(F.desc("run_id"))).alias("place")).join(F.broadcast(last))  # one row


@query("select photo_id, round(score / 30, 4) as score, row_number() over (partition by device_id order by round(score / 30, 4) desc, created_at desc, photo_id) as place from media")
def result_order(t):
    s = F.round(F.col("score") / 30, 4)
    return t.media.select("photo_id", s.alias("score"), F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc(s), F.desc("created_at"), "photo_id")).alias("place"))


_HEAD = "select *, row_number() over (partition by device_id order by score desc, photo_id) as was from media"


@query(f"select photo_id, device_id, row_number() over (partition by device_id order by case when was <= 20 then 0 else 1 end, case when was <= 20 then round(0.4 * score + 0.6 * faces, 6) end desc, was) as place from ({_HEAD})")
def rerank_head(t):
    ranked = t.media.withColumn("was", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("score"), "photo_id")))
    head = F.col("was") <= 20
    fresh = F.when(head, F.round(0.4 * F.col("score") + 0.6 * F.col("faces"), 6))
    return ranked.select("photo_id", "device_id", F.row_number().over(Window.partitionBy("device_id").orderBy(F.when(head, 0).otherwise(1), F.desc(fresh), "was")).alias("place"))


@query(f"select device_id, memory_id, row_number() over (partition by device_id order by {_RANK}, priority desc, updated_at, memory_id) as place from notes")
def report_order(t):
    return t.notes.select("device_id", "memory_id", F.row_number().over(Window.partitionBy("device_id").orderBy(F.expr(_RANK), F.desc("priority"), "updated_at", "memory_id")).alias("place"))


@query("select seq, memory_id, row_number() over (order by created_at desc, seq) as place from outbox where state = 'conflict' order by created_at desc, seq limit 50")
def conflict_list(t):
    head = t.outbox.where("state = 'conflict'").orderBy(F.desc("created_at"), "seq").limit(50)
    return head.select("seq", "memory_id", F.row_number().over(Window.orderBy(F.desc("created_at"), "seq")).alias("place"))


@query("select memory_id, 'local' as place from local_notes union all select memory_id, 'replica' from replica_notes")
def all_shards(t):
    return t.local_notes.select("memory_id", F.lit("local").alias("place")).unionByName(t.replica_notes.select("memory_id", F.lit("replica").alias("place")))


@query("select memory_id from local_notes union select memory_id from replica_notes")
def known_ids(t):
    return t.local_notes.select("memory_id").union(t.replica_notes.select("memory_id")).distinct()


@query("select memory_id, coalesce(d.role = 'trainee' and not d.trusted and n.scope <> 'private', false) as needs_review from notes n left join devices d using (device_id)")
def needs_review(t):
    df = t.notes.join(t.devices.select("device_id", F.col("role").alias("d_role"), "trusted"), "device_id", "left")
    return df.select("memory_id", F.coalesce((F.col("d_role") == "trainee") & ~F.col("trusted") & (F.col("scope") != "private"), F.lit(False)).alias("needs_review"))
