"""Reconciling device copies with the shared table: merge, plans, guarded writes."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import merge_tags
from notelake.operators.filters import blank, latest, may_see

#: The fields that a person can change. A two-sided change is a clash; tags, the eighth field, are merged as sets.
CONTENT = ["text", "kind", "asset", "status", "supersedes", "superseded_by", "relation"]


def sides(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str = "memory_id") -> DataFrame:
    """The three versions of each row as structs base, mine and theirs; base may be null."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))

    return packed(mine, "mine").join(packed(theirs, "theirs"), key).join(packed(base, "base"), key, "left")


def merged_field(c: str) -> Column:
    base, mine, theirs = (F.col(f"{s}.{c}") for s in ("base", "mine", "theirs"))
    known = F.col("base").isNotNull()
    return F.when(mine.eqNullSafe(theirs), mine).when(known & mine.eqNullSafe(base), theirs).when(known & theirs.eqNullSafe(base), mine).when(~known & mine.isNull(), theirs).otherwise(mine)


def clash(c: str) -> Column:
    base, mine, theirs = (F.col(f"{s}.{c}") for s in ("base", "mine", "theirs"))
    known = F.col("base").isNotNull()
    both = ~mine.eqNullSafe(base) & ~theirs.eqNullSafe(base)
    return ~mine.eqNullSafe(theirs) & F.when(known, both).otherwise(mine.isNotNull() & theirs.isNotNull())


def clashes() -> Column:
    """The names of the fields in clash, in the order of CONTENT."""
    return F.array_compact(F.array(*(F.when(clash(c), F.lit(c)) for c in CONTENT)))


def merged_tags() -> Column:
    tags = lambda s: F.split(F.coalesce(F.col(f"{s}.tag_text"), F.lit("")), ",")
    old = F.when(F.col("base").isNotNull(), tags("base")).otherwise(F.array().cast("array<string>"))
    return merge_tags(old, tags("mine"), tags("theirs"))


def three_way_merge(versions: DataFrame) -> DataFrame:
    """Each field merged, tags as sets, and the list of clashes; in a clash mine stays."""
    return versions.select("memory_id", *(merged_field(c).alias(c) for c in CONTENT), F.array_join(merged_tags(), ",").alias("tags"), F.array_join(clashes(), ",").alias("clashes"))


def same_content(mine: str = "mine", theirs: str = "theirs") -> Column:
    """All content fields equal, null and null too."""
    out = F.lit(True)
    for c in [*CONTENT, "tag_text"]:
        out = out & F.col(f"{mine}.{c}").eqNullSafe(F.col(f"{theirs}.{c}"))
    return out


def push_plan(entries: DataFrame) -> DataFrame:
    """Action, revision to write and revision to expect for upserts; ``entries`` has base_rev and the structs mine, theirs and base, which may be null."""
    gone, cloud = F.col("mine").isNull() | (F.col("mine.scope") == "private"), F.col("theirs")
    rev = F.col("theirs.rev")
    action = (
        F.when(gone, "cancelled").when(cloud.isNull(), "create").when(rev == F.col("base_rev"), "write").when(same_content(), "adopt").when(F.col("theirs.status") == "deleted", "restore").when(F.size(clashes()) > 0, "conflict").otherwise("merge")
    )
    df = entries.withColumn("action", action)
    a = F.col("action")
    to = F.when(a.isin("create", "write"), F.col("mine.rev")).when(a == "adopt", rev).when(a == "restore", rev + 1).when(a == "merge", F.greatest(rev, F.col("mine.rev")) + 1)
    expect = F.when(a == "write", F.col("base_rev")).when(a.isin("restore", "merge"), rev)
    return df.select("memory_id", "action", to.alias("rev"), expect.alias("expect"))


def pull_plan(manifest: DataFrame, local: DataFrame, replica: DataFrame, open_ops: DataFrame) -> DataFrame:
    """What a device does with each row of the manifest."""
    m = manifest.select("memory_id", F.col("rev").alias("c_rev"), F.col("status").alias("c_status"), F.col("review").alias("c_review"), F.col("priority").alias("c_priority"))
    own = local.select("memory_id", F.col("rev").alias("l_rev"), F.col("scope").alias("l_scope"))
    copy = replica.select("memory_id", F.col("rev").alias("r_rev"), F.col("via_peer").alias("r_peer"))
    busy = open_ops.select("memory_id").distinct().withColumn("busy", F.lit(True))
    df = m.join(own, "memory_id", "left").join(copy, "memory_id", "left").join(busy, "memory_id", "left")
    here, held, gone = F.col("l_rev").isNotNull(), F.col("r_rev").isNotNull(), F.col("c_status") == "deleted"
    action = (
        F.when(here & (F.col("busy").isNotNull() | (F.col("l_scope") == "private")), "skip")
        .when(here & gone & F.col("c_review").eqNullSafe("rejected"), "take back")
        .when(here & gone, "delete")
        .when(here & (F.col("c_rev") > F.col("l_rev")), "refresh")
        .when(here, "keep")
        .when(gone | ~may_see(prefix="c_"), F.when(held, "drop copy").otherwise("ignore"))
        .when(~held | (F.col("r_rev") != F.col("c_rev")) | F.col("r_peer").isNotNull(), "fetch")
        .otherwise("keep")
    )
    return df.select("memory_id", action.alias("action"))


def removal_plan(entries: DataFrame, cloud: DataFrame) -> DataFrame:
    """Delete and retract entries against the shared row: action and the tombstone's revision."""
    c = cloud.select("memory_id", F.col("rev").alias("c_rev"), F.col("status").alias("c_status"))
    df = entries.join(c, "memory_id", "left")
    action = F.when(F.col("c_rev").isNull() | (F.col("c_status") == "deleted"), "finish").when((F.col("op") == "delete") & (F.col("c_rev") != F.col("base_rev")), "cancelled").otherwise("tombstone")
    return df.select("seq", "memory_id", "op", action.alias("action"), F.when(action == "tombstone", F.col("c_rev") + 1).alias("rev"))


def review_plan(decisions: DataFrame, cloud: DataFrame) -> DataFrame:
    """Decisions (approve, seen_rev, seen_text) against the shared row."""
    c = cloud.select("memory_id", F.col("rev").alias("c_rev"), F.col("review").alias("c_review"), F.col("status").alias("c_status"), F.col("text").alias("c_text"))
    df = decisions.join(c, "memory_id", "left")
    moved = (F.col("seen_rev") != F.col("c_rev")) & ~F.col("seen_text").eqNullSafe(F.col("c_text"))
    action = F.when(F.col("c_rev").isNull() | (F.col("c_status") == "deleted"), "cancelled").when(~F.col("c_review").eqNullSafe("pending"), "cancelled").when(moved, "back to queue").when(F.col("approve"), "patch").otherwise("tombstone")
    return df.select("memory_id", action.alias("action"), F.when(action.isin("patch", "tombstone"), F.col("c_rev") + 1).alias("rev"))


def guarded_writes(writes: DataFrame) -> DataFrame:
    """Fold each id's writes in order of seq: a write (or tombstone) lands if it expects nothing, the row is absent, or the revision is the expected one.

    A patch (``kind``, where there is such a column) lands only on a row that
    is there with the expected revision. An id's writes pass by in order in one
    task, which holds one revision.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for b in batches:
            landed = []
            for key, expect, rev, patch in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if key != now:
                    now, at = key, None
                landed.append(at is not None and expect == at if patch else expect is None or at is None or expect == at)
                at = rev if landed[-1] else at
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(landed, pa.bool_())], names=["memory_id", "seq", "landed"])

    patch = F.coalesce(F.col("kind") == "patch", F.lit(False)) if "kind" in writes.columns else F.lit(False)
    rows = writes.select(F.col("memory_id").cast("long"), F.col("seq").cast("long"), F.col("expect_rev").cast("int"), F.col("rev").cast("int"), patch.alias("patch"))
    return rows.repartition("memory_id").sortWithinPartitions("memory_id", "seq", "rev").mapInArrow(run, "memory_id long, seq long, landed boolean")


def apply_cloud_content(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Shared content copied to the device's row, which keeps its unmasked text where the shared one is its masked form."""
    c = cloud.select("memory_id", F.col("text").alias("c_text"), F.col("status").alias("c_status"))
    df = local.join(c, "memory_id")
    text = F.when(F.col("c_text").eqNullSafe(blank(F.col("shared_text"))), F.col("text")).otherwise(F.col("c_text"))
    return df.select("memory_id", text.alias("text"), F.col("c_status").alias("status"))


def fetch_from_peer(plan: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a peer that ``plan`` (memory_id, rev, action) asks for: ``fetch`` gets the memory_ids and returns the peer's rows, of which those as new as the plan said are taken, once each."""
    wanted = plan.where(F.col("action").isin("new", "newer")).select("memory_id", F.col("rev").alias("_rev")).distinct()
    got = fetch(wanted.select("memory_id"))
    return latest(got.join(wanted, "memory_id").where(F.col("rev") >= F.col("_rev")).drop("_rev").withColumn("_old", -F.col("rev")), ["memory_id"], "_old").drop("_old")
