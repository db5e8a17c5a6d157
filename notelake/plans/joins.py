"""Sync: merges, plans, anti joins, guarded writes, recursive chains, nearest rows."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.operators import chains
from notelake.operators import filters as f
from notelake.operators import sync as s
from notelake.operators.skew import dealt
from notelake.plans.registry import ORACLES, query
from notelake.plans.scans import payload_only
from notelake.sources.tables import with_tables

_FIELDS = [*s.CONTENT, "tag_text", "scope", "rev"]


def _versions(t):
    return s.sides(t.base_notes.select("memory_id", *_FIELDS), t.local_notes.select("memory_id", *_FIELDS), t.cloud_notes.select("memory_id", *_FIELDS))


def _merge(c):
    return f"case when m.{c} is not distinct from h.{c} then m.{c} when b.memory_id is not null and m.{c} is not distinct from b.{c} then h.{c} when b.memory_id is not null and h.{c} is not distinct from b.{c} then m.{c} when b.memory_id is null and m.{c} is null then h.{c} else m.{c} end"


def _clash(c):
    return f"(m.{c} is distinct from h.{c} and case when b.memory_id is not null then m.{c} is distinct from b.{c} and h.{c} is distinct from b.{c} else m.{c} is not null and h.{c} is not null end)"


_CLASHES = "list_filter([" + ", ".join(f"case when {_clash(c)} then '{c}' end" for c in s.CONTENT) + "], lambda y: y is not null)"
_JOINED = "local_notes m join cloud_notes h using (memory_id) left join base_notes b using (memory_id)"
_TAGS = "array_to_string(list_sort(list_distinct(list_concat(list_filter({o}, lambda y: list_contains({m}, y) and list_contains({h}, y)), list_filter(list_concat({m}, {h}), lambda y: not list_contains({o}, y))))), ',')".format(
    o="case when b.memory_id is null then []::varchar[] else string_split(b.tag_text, ',') end", m="string_split(m.tag_text, ',')", h="string_split(h.tag_text, ',')"
)


@query(f"select memory_id, {', '.join(f'{_merge(c)} as {c}' for c in s.CONTENT)}, {_TAGS} as tags, array_to_string({_CLASHES}, ',') as clashes from {_JOINED}")
def three_way_merge(t):
    return s.three_way_merge(_versions(t))


_SAME = " and ".join(f"m.{c} is not distinct from h.{c}" for c in [*s.CONTENT, "tag_text"])
_PUSH = f"""
select memory_id, action, case when action in ('create', 'write') then m_rev when action = 'adopt' then h_rev when action = 'restore' then h_rev + 1 when action = 'merge' then greatest(h_rev, m_rev) + 1 end as rev,
  case when action = 'write' then base_rev when action in ('restore', 'merge') then h_rev end as expect
from (select e.memory_id, e.base_rev, m.rev as m_rev, h.rev as h_rev, case when m.memory_id is null or m.scope = 'private' then 'cancelled' when h.memory_id is null then 'create' when h.rev = e.base_rev then 'write' when {_SAME} then 'adopt' when h.status = 'deleted' then 'restore'
  when len({_CLASHES}) > 0 then 'conflict' else 'merge' end as action
  from (select memory_id, base_rev from notes) e left join local_notes m using (memory_id) left join cloud_notes h using (memory_id) left join base_notes b using (memory_id))"""


@query(_PUSH)
def push_plan(t):
    def packed(df, name):
        return df.select("memory_id", F.struct(*_FIELDS).alias(name))

    entries = t.notes.select("memory_id", "base_rev")
    for df, name in ((t.local_notes, "mine"), (t.cloud_notes, "theirs"), (t.base_notes, "base")):
        entries = entries.join(packed(df, name), "memory_id", "left")
    return s.push_plan(entries)


_OPEN = "(select distinct memory_id from outbox where state in ('pending', 'conflict'))"


@query(f"""
select memory_id, case when l.memory_id is not null and (o.memory_id is not null or l.scope = 'private') then 'skip' when l.memory_id is not null and c.status = 'deleted' and c.review is not distinct from 'rejected' then 'take back'
  when l.memory_id is not null and c.status = 'deleted' then 'delete' when l.memory_id is not null and c.rev > l.rev then 'refresh' when l.memory_id is not null then 'keep'
  when c.status = 'deleted' or not (c.review is distinct from 'pending' or c.priority >= 2) then case when r.memory_id is not null then 'drop copy' else 'ignore' end
  when r.memory_id is null or r.rev <> c.rev or r.via_peer is not null then 'fetch' else 'keep' end as action
from cloud_notes c left join local_notes l using (memory_id) left join replica_notes r using (memory_id) left join {_OPEN} o using (memory_id)""")
def pull_plan(t):
    return s.pull_plan(t.cloud_notes, t.local_notes, t.replica_notes, t.outbox.where("state in ('pending', 'conflict')"))


@query("select memory_id from replica_notes where memory_id not in (select memory_id from cloud_notes) and via_peer is null")
def gone_rows(t):
    return t.replica_notes.where("via_peer is null").join(t.cloud_notes.select("memory_id"), "memory_id", "left_anti").select("memory_id")


@query(f"select memory_id, 'pending' as sync_state, 0 as base_rev from local_notes where sync_state = 'synced' and memory_id not in (select memory_id from cloud_notes) and memory_id not in {_OPEN}")
def requeue_missing(t):
    open_ops = t.outbox.where("state in ('pending', 'conflict')").select("memory_id")
    lost = t.local_notes.where("sync_state = 'synced'").join(t.cloud_notes.select("memory_id"), "memory_id", "left_anti").join(open_ops, "memory_id", "left_anti")
    return lost.select("memory_id", F.lit("pending").alias("sync_state"), F.lit(0).alias("base_rev"))


@query("select count(*) as behind, count(*) >= 200 as use_snapshot from cloud_notes c left join (select memory_id, max(rev) as rev from (select memory_id, rev from local_notes union all select memory_id, rev from replica_notes) group by memory_id) h using (memory_id) where status <> 'deleted' and (review is distinct from 'pending' or priority >= 2) and (h.rev is null or h.rev < c.rev)")
def behind_count(t):
    held = t.local_notes.select("memory_id", "rev").unionByName(t.replica_notes.select("memory_id", "rev")).groupBy("memory_id").agg(F.max("rev").alias("held"))
    rows = t.cloud_notes.where((F.col("status") != "deleted") & f.may_see()).join(held, "memory_id", "left").where("held is null or held < rev")
    return rows.agg(F.count("*").alias("behind"), (F.count("*") >= 200).alias("use_snapshot"))


@query("select memory_id, p.rev, case when p.status = 'deleted' then 'drop' when r.memory_id is null then 'new' else 'newer' end as action from cloud_notes p left join replica_notes r using (memory_id) where memory_id not in (select memory_id from local_notes) and (p.review is distinct from 'pending' or p.priority >= 2) and (r.memory_id is null or p.rev > r.rev)")
def peer_plan(t):
    shown = dealt(t.cloud_notes.where(f.may_see()).select("memory_id", "rev", "status"), "memory_id")
    offered = shown.join(t.local_notes.select("memory_id"), "memory_id", "left_anti")
    df = offered.join(t.replica_notes.select("memory_id", F.col("rev").alias("own")), "memory_id", "left").where("own is null or rev > own")
    return df.select("memory_id", "rev", F.when(F.col("status") == "deleted", "drop").when(F.col("own").isNull(), "new").otherwise("newer").alias("action"))


_OFFER = "select memory_id, rev, status, review, priority, 0 as place from local_notes where scope <> 'private' and not withdrawn and sync_state <> 'private' union all select memory_id, rev, status, review, priority, 1 from replica_notes"


@query(f"select memory_id, rev, status, review, priority, place from (select *, row_number() over (partition by memory_id order by place) as n from ({_OFFER})) where n = 1")
def peer_manifest(t):
    cols = ["memory_id", "rev", "status", "review", "priority"]
    offer = t.local_notes.where(f.shareable()).select(*cols, F.lit(0).alias("place")).unionByName(t.replica_notes.select(*cols, F.lit(1).alias("place")))
    return f.latest(offer, ["memory_id"], "place")


@query("select memory_id, case when scope = 'redacted' then coalesce(nullif(shared_text, ''), text) else text end as text, scope = 'redacted' as redacted from local_notes where scope <> 'private' and not withdrawn and sync_state <> 'private' and memory_id in (select memory_id from outbox)")
def peer_records(t):
    asked = t.outbox.select("memory_id")
    return t.local_notes.where(f.shareable()).join(asked, "memory_id", "left_semi").select("memory_id", f.outgoing_text().alias("text"), (F.col("scope") == "redacted").alias("redacted"))


@query("select memory_id, c.rev as rev, case when c.scope = 'redacted' then coalesce(nullif(c.shared_text, ''), c.text) else c.text end as text from cloud_notes c left join replica_notes r using (memory_id) where memory_id not in (select memory_id from local_notes) and c.status <> 'deleted' and (c.review is distinct from 'pending' or c.priority >= 2) and (r.memory_id is null or c.rev > r.rev)")
def peer_fetch(t):
    """The rows of ``peer_plan`` as the peer gives them: masked where they are shared masked."""
    peer = lambda ids: t.cloud_notes.join(ids, "memory_id", "left_semi").select("memory_id", "rev", f.outgoing_text().alias("text"))
    return s.fetch_from_peer(peer_plan(t), peer)


@query("select photo_id, case when m.status = 'deleted' and held = 'replica' then 'remove' when m.status = 'deleted' then 'gone' when n.memory_id is null then 'gone' when held = 'queued' then 'fetch' else 'keep' end as action from media m left join replica_notes n using (memory_id)")
def media_plan(t):
    known = t.replica_notes.select("memory_id").withColumn("known", F.lit(True))
    df = t.media.join(known, "memory_id", "left")
    gone = F.col("status") == "deleted"
    return df.select("photo_id", F.when(gone & (F.col("held") == "replica"), "remove").when(gone | F.col("known").isNull(), "gone").when(F.col("held") == "queued", "fetch").otherwise("keep").alias("action"))


@query("select memory_id, array_to_string(list(photo_id order by created_at, photo_id), ',') as photos, count(*) as n from media where status = 'active' and memory_id in (select memory_id from local_notes) group by memory_id")
def photos_of_notes(t):
    rows = t.media.where("status = 'active'").join(t.local_notes.select("memory_id"), "memory_id", "left_semi")
    sorted_ids = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "photo_id"))), lambda x: x["photo_id"])
    return rows.groupBy("memory_id").agg(F.array_join(sorted_ids, ",").alias("photos"), F.count("*").alias("n"))


@query(f"select memory_id, row_number() over (partition by site order by priority desc, created_at, memory_id) as place from cloud_notes where review = 'pending' and status <> 'deleted' and memory_id not in {_OPEN}")
def approvals(t):
    rows = t.cloud_notes.where("review = 'pending' and status <> 'deleted'").join(t.outbox.where("state in ('pending', 'conflict')").select("memory_id"), "memory_id", "left_anti")
    return rows.select("memory_id", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("priority"), "created_at", "memory_id")).alias("place"))


@query("select seq, o.memory_id, o.op, coalesce(l.text, b.text, '') as text from outbox o left join local_notes l using (memory_id) left join base_notes b using (memory_id) where o.state in ('pending', 'conflict', 'failed')")
def outbox_view(t):
    own, base = t.local_notes.select("memory_id", F.col("text").alias("own")), t.base_notes.select("memory_id", F.col("text").alias("base"))
    rows = t.outbox.where("state in ('pending', 'conflict', 'failed')").join(own, "memory_id", "left").join(base, "memory_id", "left")
    return rows.select("seq", "memory_id", "op", F.coalesce("own", "base", F.lit("")).alias("text"))


@query("""with recursive c as (select memory_id as head, memory_id, supersedes, 0 as depth, [memory_id] as path from notes where status = 'active'
union all select c.head, n.memory_id, n.supersedes, c.depth + 1, list_append(c.path, n.memory_id) from c join notes n on n.memory_id = c.supersedes where not list_contains(c.path, n.memory_id))
select head, memory_id, depth from c""")
def history_chain(t):
    """Each active note's earlier versions; a chain never visits a note twice."""
    return chains.ancestors(t.notes, heads=t.notes.where("status = 'active'")).select("head", F.col("node").alias("memory_id"), "depth")


@query("select r.memory_id, 'private' as scope, false as withdrawn, c.review_reason as reason, greatest(r.rev, c.rev) as rev from local_notes r join cloud_notes c using (memory_id) where c.status = 'deleted' and c.review = 'rejected'")
def take_back(t):
    c = t.cloud_notes.where("status = 'deleted' and review = 'rejected'").select("memory_id", F.col("rev").alias("c_rev"), F.col("review_reason").alias("reason"))
    return t.local_notes.join(c, "memory_id").select("memory_id", F.lit("private").alias("scope"), F.lit(False).alias("withdrawn"), "reason", F.greatest("rev", "c_rev").alias("rev"))


@query("""with k as (select memory_id, m.text as mine, h.text as theirs, m.rev as mr, h.rev as hr, ['mine', 'theirs', 'both', 'merge'][memory_id % 4 + 1] as choice from local_notes m join cloud_notes h using (memory_id) where m.sync_state = 'conflict')
select memory_id, choice, case choice when 'theirs' then theirs when 'merge' then mine || ' / ' || theirs else mine end as text, greatest(mr, hr) + 1 as rev from k union all select -memory_id, choice, theirs, hr from k where choice = 'both'""")
def resolve_conflicts(t):
    k = t.local_notes.where("sync_state = 'conflict'").select("memory_id", F.col("text").alias("mine"), F.col("rev").alias("mr")).join(t.cloud_notes.select("memory_id", F.col("text").alias("theirs"), F.col("rev").alias("hr")), "memory_id")
    k = k.withColumn("choice", F.get(F.array(*map(F.lit, ("mine", "theirs", "both", "merge"))), (F.col("memory_id") % 4).cast("int")))
    text = F.when(F.col("choice") == "theirs", F.col("theirs")).when(F.col("choice") == "merge", F.concat("mine", F.lit(" / "), "theirs")).otherwise(F.col("mine"))
    done = k.select("memory_id", "choice", text.alias("text"), (F.greatest("mr", "hr") + 1).alias("rev"))
    return done.unionByName(k.where("choice = 'both'").select((-F.col("memory_id")).alias("memory_id"), "choice", F.col("theirs").alias("text"), F.col("hr").alias("rev")))


@query(
    """with recursive w as (select memory_id, seq, case when seq % 5 = 0 then null else base_rev end as expect, base_rev + 1 as rev, seq % 6 = 0 as patch, row_number() over (partition by memory_id order by seq) as n from outbox where op = 'upsert'),
f as (select memory_id, seq, n, not patch as landed, case when not patch then rev end as rev from w where n = 1 union all select w.memory_id, w.seq, w.n, case when w.patch then coalesce(w.expect = f.rev, false) else f.rev is null or w.expect is null or w.expect = f.rev end,
  case when case when w.patch then coalesce(w.expect = f.rev, false) else f.rev is null or w.expect is null or w.expect = f.rev end then w.rev else f.rev end from f join w on w.memory_id = f.memory_id and w.n = f.n + 1)
select memory_id, seq, landed from f"""
)
def cas_apply(t):
    kind = F.when(F.col("seq") % 6 == 0, "patch").when(F.col("seq") % 6 == 1, "tombstone").otherwise("write")
    w = t.outbox.where("op = 'upsert'").select("memory_id", "seq", kind.alias("kind"), F.when(F.col("seq") % 5 != 0, F.col("base_rev")).alias("expect_rev"), (F.col("base_rev") + 1).cast("int").alias("rev"))
    return s.guarded_writes(w)


@query("select memory_id, case when h.text is not distinct from nullif(m.shared_text, '') then m.text else h.text end as text, h.status from local_notes m join cloud_notes h using (memory_id)")
def apply_cloud_content(t):
    return s.apply_cloud_content(t.local_notes, t.cloud_notes)


@query("select seq, o.memory_id, o.op, case when c.rev is null or c.status = 'deleted' then 'finish' when o.op = 'delete' and c.rev <> o.base_rev then 'cancelled' else 'tombstone' end as action, case when not (c.rev is null or c.status = 'deleted') and not (o.op = 'delete' and c.rev <> o.base_rev) then c.rev + 1 end as rev from outbox o left join cloud_notes c using (memory_id) where o.op in ('delete', 'retract')")
def removal_plan(t):
    return s.removal_plan(t.outbox.where("op in ('delete', 'retract')").select("seq", "memory_id", "op", "base_rev"), t.cloud_notes)


@query("""select n.memory_id, case when c.rev is null or c.status = 'deleted' or c.review is distinct from 'pending' then 'cancelled' when n.rev <> c.rev and n.text is distinct from c.text then 'back to queue' when n.memory_id % 2 = 0 then 'patch' else 'tombstone' end as action,
case when not (c.rev is null or c.status = 'deleted' or c.review is distinct from 'pending') and not (n.rev <> c.rev and n.text is distinct from c.text) then c.rev + 1 end as rev from base_notes n left join cloud_notes c using (memory_id)""")
def review_plan(t):
    seen = t.base_notes.select("memory_id", (F.col("memory_id") % 2 == 0).alias("approve"), F.col("rev").alias("seen_rev"), F.col("text").alias("seen_text"))
    return s.review_plan(seen, t.cloud_notes)


_REV = "select memory_id, flags, quantity, ts, row_number() over (partition by memory_id order by ts, line, part, supp, quantity) as rev from revisions"


@query(f"select n.memory_id, r.rev as from_rev, n.rev + 1 as rev, r.flags, r.quantity from notes n join ({_REV}) r on r.memory_id = n.memory_id and r.rev = n.base_rev")
def restore_revision(t):
    order = Window.partitionBy("memory_id").orderBy("ts", "line", "part", "supp", "quantity")
    past = t.revisions.withColumn("from_rev", F.row_number().over(order)).select("memory_id", "from_rev", "flags", "quantity")
    now = t.notes.select("memory_id", F.col("base_rev").alias("from_rev"), (F.col("rev") + 1).alias("rev"))
    return now.join(past, ["memory_id", "from_rev"]).select("memory_id", "from_rev", "rev", "flags", "quantity")


@query("select l.memory_id, coalesce(o.base_rev, case when l.sync_state = 'synced' then l.rev end, l.base_rev) as base from local_notes l left join (select memory_id, min(base_rev) as base_rev from outbox where state in ('pending', 'conflict', 'failed') group by memory_id) o using (memory_id)")
def base_version(t):
    entry = t.outbox.where("state in ('pending', 'conflict', 'failed')").groupBy("memory_id").agg(F.min("base_rev").alias("entry_base"))
    df = t.local_notes.join(entry, "memory_id", "left")
    return df.select("memory_id", F.coalesce("entry_base", F.when(F.col("sync_state") == "synced", F.col("rev")), F.col("base_rev")).alias("base"))


@query("select photo_id, case when n.memory_id is null or n.scope = 'private' or p.width = 0 then 'cancelled' else 'send' end as action, case when n.memory_id is not null and n.scope <> 'private' and p.width <> 0 then case when n.scope = 'redacted' then coalesce(nullif(n.shared_text, ''), n.text) else n.text end end as caption from media p left join notes n using (memory_id) where held = 'queued'")
def media_push_plan(t):
    notes = t.notes.select("memory_id", "scope", f.outgoing_text().alias("caption"))
    df = t.media.where("held = 'queued'").join(notes, "memory_id", "left")
    stop = F.col("scope").isNull() | (F.col("scope") == "private") | (F.col("width") == 0)
    return df.select("photo_id", F.when(stop, "cancelled").otherwise("send").alias("action"), F.when(~stop, F.col("caption")).alias("caption"))


@query("select photo_id, memory_id, case when held = 'queued' then 'replica' else held end as held, 'shared' as scope from media where status = 'active' and memory_id not in (select memory_id from notes where status = 'deleted')")
def media_receive(t):
    gone = t.notes.where("status = 'deleted'").select("memory_id")
    rows = t.media.where("status = 'active'").join(gone, "memory_id", "left_anti")
    return rows.select("photo_id", "memory_id", F.when(F.col("held") == "queued", "replica").otherwise(F.col("held")).alias("held"), F.lit("shared").alias("scope"))


@query("""with recursive c as (select memory_id as head, memory_id, supersedes, [memory_id] as path from local_notes
union all select c.head, n.memory_id, n.supersedes, list_append(c.path, n.memory_id) from c join local_notes n on n.memory_id = c.supersedes where not list_contains(c.path, n.memory_id)),
h as (select head, count(*) as versions, min(memory_id) as oldest from c group by head),
o as (select memory_id, min(seq) as open_seq, arg_min(op, seq) as open_op, arg_min(state, seq) as open_state from outbox where state in ('pending', 'conflict') group by 1),
p as (select memory_id, count(*) as photos, max(photo_id) as newest_photo from media where status = 'active' group by 1), r as (select memory_id, count(*) as revisions from revisions group by 1)
select n.memory_id, n.text, coalesce(photos, 0) as photos, newest_photo, coalesce(revisions, 0) as revisions, versions, oldest, open_seq, open_op, open_state
from local_notes n left join p using (memory_id) left join r using (memory_id) left join o using (memory_id) left join h on h.head = n.memory_id""")
def note_detail(t):
    photos = t.media.where("status = 'active'").groupBy("memory_id").agg(F.count("*").alias("photos"), F.max("photo_id").alias("newest_photo"))
    past = t.revisions.groupBy("memory_id").agg(F.count("*").alias("revisions"))
    ops = t.outbox.where("state in ('pending', 'conflict')").groupBy("memory_id").agg(F.min("seq").alias("open_seq"), F.min_by("op", "seq").alias("open_op"), F.min_by("state", "seq").alias("open_state"))
    chain = chains.ancestors(t.local_notes).groupBy(F.col("head").alias("memory_id")).agg(F.count("*").alias("versions"), F.min("node").alias("oldest"))
    df = t.local_notes.select("memory_id", "text")
    for part in (photos, past, chain, ops):
        df = df.join(part, "memory_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select("memory_id", "text", none("photos"), "newest_photo", none("revisions"), "versions", "oldest", "open_seq", "open_op", "open_state")


# Bytes of a dense vector and of each entry of a sparse one, and what leaves a device of a note and of one that is gone.
DENSE, ENTRY = 4 * 384, 8
SENT = ["kind", "asset", "tag_text", "site", "category", "priority", "device_id", "origin_device", "author", "status", "rev", "supersedes", "superseded_by", "relation", "review"]
_OUT = "case when scope = 'redacted' then coalesce(nullif(shared_text, ''), text) else text end"
_PACK = lambda text, side: f"length(to_json(struct_pack(\"text\" := {text}, redacted := scope = 'redacted', {', '.join(f'{c} := {side}.{c}' for c in SENT)}))::varchar)"
_TERMS = lambda text: f"{ENTRY} * len(list_distinct(string_split(lower({text}), ' ')))"


def note_bytes(text, fields, vectors):
    """Bytes of a note on its way: its fields as JSON, and 8 for each term of the sparse vector and 1536 for the dense one where they go along."""
    body = F.length(F.to_json(F.struct(text.alias("text"), (F.col("scope") == "redacted").alias("redacted"), *fields), {"ignoreNullFields": "false"}))
    return body if vectors is None else body + ENTRY * F.size(F.array_distinct(F.split(F.lower(text), " "))) + F.when(vectors, DENSE).otherwise(0)


@query()
def transfer_bytes(t):
    """Bytes of each device and direction: notes and removals that its queue writes, and notes that its pull brings."""
    sends = push_plan(t).where("action in ('create', 'write', 'restore', 'merge')").select("memory_id")
    light = payload_only(t).where("payload_only").select("memory_id", F.lit(True).alias("light"))
    up = t.local_notes.join(sends, "memory_id").join(light, "memory_id", "left").select("device_id", F.lit("up").alias("direction"), note_bytes(f.outgoing_text(), SENT, F.col("light").isNull()).alias("bytes"))
    gone = removal_plan(t).where("action = 'tombstone'").select("seq", "memory_id", F.col("rev").alias("to")).join(t.cloud_notes, "memory_id").join(t.outbox.select("seq", F.col("device_id").alias("by")), "seq")
    fields = [F.col("to").alias("rev"), "site", "asset", F.col("by").alias("device_id"), "origin_device"]
    removed = gone.select(F.col("by").alias("device_id"), F.lit("up").alias("direction"), note_bytes(F.lit(""), fields, None).alias("bytes"))
    brings = pull_plan(t).where("action in ('fetch', 'refresh')").select("memory_id")
    down = t.cloud_notes.join(brings, "memory_id").select("device_id", F.lit("down").alias("direction"), note_bytes(F.col("text"), SENT, F.lit(True)).alias("bytes"))
    return up.unionByName(removed).unionByName(down).groupBy("device_id", "direction").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))


ORACLES["transfer_bytes"] = with_tables(f"""with push as ({ORACLES['push_plan']}), pull as ({ORACLES['pull_plan']}), thin as ({ORACLES['payload_only']}), gone as ({ORACLES['removal_plan']}),
u as (select l.device_id, 'up' as direction, {_PACK(_OUT, 'l')} + {_TERMS(_OUT)} + case when coalesce(thin.payload_only, false) then 0 else {DENSE} end as bytes from local_notes l join push using (memory_id) left join thin using (memory_id) where push.action in ('create', 'write', 'restore', 'merge')),
g as (select o.device_id as sender, c.scope, gone.rev as new_rev, c.site, c.asset, c.origin_device from gone join cloud_notes c using (memory_id) join outbox o using (seq) where gone.action = 'tombstone'),
x as (select sender as device_id, 'up' as direction, length(to_json(struct_pack("text" := '', redacted := scope = 'redacted', rev := new_rev, site := site, asset := asset, device_id := sender, origin_device := origin_device))::varchar) as bytes from g),
d as (select c.device_id, 'down' as direction, {_PACK('text', 'c')} + {_TERMS('text')} + {DENSE} as bytes from cloud_notes c join pull using (memory_id) where pull.action in ('fetch', 'refresh'))
select device_id, direction, sum(bytes)::bigint as bytes, count(*) as "rows" from (select * from u union all select * from x union all select * from d) group by device_id, direction""")
