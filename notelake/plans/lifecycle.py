"""Edits, deletions, withdrawals, announcements, review and media of notes."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.operators import lifecycle as m
from notelake.plans.policy import decided
from notelake.plans.registry import query

NOW = "timestamp '1998-06-01 00:00:00'"


def _to_capture(t):
    """Every document that has a vector as a new note: decided, about the label as its asset, in the order of its id."""
    notes = t.embeddings.select(F.col("vec_id").alias("memory_id"), F.col("label").cast("string").alias("asset"), F.col("vec_id").alias("at"), "embedding")
    said = decided(t).select(F.col("doc_id").alias("memory_id"), "text", "scope", "priority")
    return notes.join(said, "memory_id", "left").join(t.notes.select("memory_id", "kind"), "memory_id", "left")


@query()
def capture_batch(t):
    """Notes in time order within an asset: a duplicate is dropped, a follow-up supersedes, all else is stored; what is not private is queued."""
    return m.capture(_to_capture(t), same=0.5, follows=0.35)


@query()
def capture_revisions(t):
    return m.captured_revisions(m.capture(_to_capture(t), same=0.5, follows=0.35))


@query("select n.memory_id, o.memory_id as replaces from notes n join notes o on o.memory_id = n.supersedes where o.kind <> 'reference' and not (n.scope <> 'private' and o.scope = 'private')")
def supersede(t):
    o = t.notes.where("kind <> 'reference'").select(F.col("memory_id").alias("replaces"), F.col("scope").alias("o_scope"))
    return t.notes.join(o, F.col("supersedes") == F.col("replaces")).where("not (scope <> 'private' and o_scope = 'private')").select("memory_id", "replaces")


@query("select memory_id, coalesce(e.text, l.text) as text, l.rev + 1 as rev, case when l.scope = 'private' then 'private' else 'pending' end as sync_state, case when l.scope <> 'private' then 'upsert' end as op from local_notes l join base_notes e using (memory_id) where e.text is distinct from l.text or e.tag_text is distinct from l.tag_text")
def apply_edits(t):
    return m.apply_edits(t.local_notes, t.base_notes.select("memory_id", "text", "tag_text"))


@query("select memory_id, case when base_rev > 0 then 'tombstone' else 'cancel' end as op, (select count(*) from media p where p.memory_id = l.memory_id) as photos from local_notes l where status = 'deleted'")
def delete_notes(t):
    photos = t.media.groupBy("memory_id").agg(F.count("*").alias("photos"))
    gone = t.local_notes.where("status = 'deleted'").join(photos, "memory_id", "left")
    return gone.select("memory_id", F.when(F.col("base_rev") > 0, "tombstone").otherwise("cancel").alias("op"), F.coalesce("photos", F.lit(0)).alias("photos"))


@query("select memory_id, case when base_rev > 0 then 'retract' end as op, base_rev > 0 as withdrawn from local_notes where scope <> 'private' and memory_id % 4 = 1")
def withdraw(t):
    had = F.col("base_rev") > 0
    return t.local_notes.where("scope <> 'private' and memory_id % 4 = 1").select("memory_id", F.when(had, "retract").alias("op"), had.alias("withdrawn"))


@query("select memory_id, case when role <> 'supervisor' then 'not a supervisor' when not (rev * 60 between 1 and 336) then 'hours' else 'ok' end as verdict, case when role = 'supervisor' and rev * 60 between 1 and 336 then greatest(priority, 2) end as priority, case when role = 'supervisor' and rev * 60 between 1 and 336 then created_at + to_hours(rev * 60) end as expires_at from notes where kind = 'announcement'")
def announce(t):
    hours = F.col("rev") * 60
    verdict = F.when(F.col("role") != "supervisor", "not a supervisor").when(~hours.between(1, 336), "hours").otherwise("ok")
    ok = verdict == "ok"
    rows = t.notes.where("kind = 'announcement'")
    return rows.select("memory_id", verdict.alias("verdict"), F.when(ok, F.greatest("priority", F.lit(2))).alias("priority"), F.when(ok, F.col("created_at") + F.make_dt_interval(F.lit(0), hours)).alias("expires_at"))


@query(f"select memory_id, case when shard = 'local' then 'delete' else 'drop copy' end as action from notes where kind = 'announcement' and expires_at <= {NOW}")
def sweep_expired(t):
    over = t.notes.where("kind = 'announcement' and expires_at <= timestamp_ntz '1998-06-01 00:00:00'")
    return over.select("memory_id", F.when(F.col("shard") == "local", "delete").otherwise("drop copy").alias("action"))


@query("select photo_id, n.scope, case when n.scope = 'private' and p.held <> 'local' then 'remove' when n.scope <> 'private' and p.held = 'local' then 'upload' else 'keep' end as action from media p join notes n using (memory_id) where p.status = 'active'")
def rescope_media(t):
    df = t.media.where("status = 'active'").join(t.notes.select("memory_id", "scope"), "memory_id")
    private = F.col("scope") == "private"
    return df.select("photo_id", "scope", F.when(private & (F.col("held") != "local"), "remove").when(~private & (F.col("held") == "local"), "upload").otherwise("keep").alias("action"))


@query("select photo_id, coalesce(n.supersedes, p.memory_id) as bound_to, n.memory_id is not null as known from media p left join notes n using (memory_id)")
def attach_media(t):
    df = t.media.join(t.notes.select("memory_id", "supersedes", F.lit(True).alias("is_known")), "memory_id", "left")
    return df.select("photo_id", F.coalesce("supersedes", "memory_id").alias("bound_to"), F.col("is_known").isNotNull().alias("known"))


@query("select memory_id, case when role <> 'supervisor' then 'not a supervisor' when review is distinct from 'pending' then 'not waiting' when memory_id % 4 = 0 then 'needs a reason' else 'queued' end as verdict from notes")
def review_apply(t):
    verdict = F.when(F.col("role") != "supervisor", "not a supervisor").when(~F.col("review").eqNullSafe("pending"), "not waiting").when(F.col("memory_id") % 4 == 0, "needs a reason").otherwise("queued")
    return t.notes.select("memory_id", verdict.alias("verdict"))


@query("select m.memory_id, m.text as mine, h.text as theirs, b.text as base from local_notes m join cloud_notes h using (memory_id) join base_notes b using (memory_id) where m.text <> h.text and m.text <> b.text and h.text <> b.text")
def conflict_hold(t):
    sides = [d.select("memory_id", F.col("text").alias(n)) for d, n in ((t.local_notes, "mine"), (t.cloud_notes, "theirs"), (t.base_notes, "base"))]
    return sides[0].join(sides[1], "memory_id").join(sides[2], "memory_id").where("mine <> theirs and mine <> base and theirs <> base")


@query("select seq, case when state = 'pending' and attempts >= 5 then 'failed' when state = 'failed' then 'pending' else state end as state, case when state = 'failed' then 0 else attempts end as attempts from outbox")
def park_retry(t):
    failed = F.col("state") == "failed"
    return t.outbox.select("seq", F.when((F.col("state") == "pending") & (F.col("attempts") >= 5), "failed").when(failed, "pending").otherwise(F.col("state")).alias("state"), F.when(failed, 0).otherwise(F.col("attempts")).alias("attempts"))


@query("select seq, memory_id, case when n.status = 'deleted' then 'deleted' when n.review = 'rejected' then 'rejected' when n.status = 'superseded' then 'superseded' else 'mine' end as reason from outbox o join notes n using (memory_id) where o.state = 'conflict'")
def close_conflicts(t):
    notes = t.notes.select("memory_id", "status", "review")
    reason = F.when(F.col("status") == "deleted", "deleted").when(F.col("review") == "rejected", "rejected").when(F.col("status") == "superseded", "superseded").otherwise("mine")
    return t.outbox.where("state = 'conflict'").select("seq", "memory_id").join(notes, "memory_id").select("seq", "memory_id", reason.alias("reason"))


@query("select memory_id, count(*) as kept from revisions where memory_id not in (select memory_id from notes where status = 'deleted') group by memory_id")
def forget_history(t):
    return t.revisions.join(t.notes.where("status = 'deleted'").select("memory_id"), "memory_id", "left_anti").groupBy("memory_id").agg(F.count("*").alias("kept"))


@query("""with e as (select *, lead(updated_at) over (partition by memory_id order by seq) as next_edit, lead(seq) over (partition by memory_id order by seq) as next_seq from outbox where op = 'upsert')
select seq, memory_id, case when next_edit is not null and next_edit - updated_at < interval '2' hour then 'rebased' else 'done' end as outcome, case when next_edit is not null and next_edit - updated_at < interval '2' hour then base_rev + 1 end as new_base from e""")
def concurrent_edit(t):
    """An edit made while an upload is under way stays queued on the revision just sent."""
    nxt = F.lead("updated_at").over(Window.partitionBy("memory_id").orderBy("seq"))
    rebased = F.coalesce(F.col("next_edit") - F.col("updated_at") < F.expr("interval '2' hour"), F.lit(False))
    e = t.outbox.where("op = 'upsert'").withColumn("next_edit", nxt)
    return e.select("seq", "memory_id", F.when(rebased, "rebased").otherwise("done").alias("outcome"), F.when(rebased, F.col("base_rev") + 1).alias("new_base"))
