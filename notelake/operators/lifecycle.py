"""Ordered folds and edits over notes."""

import heapq
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import says_resolved
from notelake.operators.components import connected_components
from notelake.operators.skew import join_counted
from notelake.sources.scratch import materialize


def apply_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows that an edit changes: new text, a revision on, and what is queued."""
    e = edits.select("memory_id", F.col("text").alias("e_text"), F.col("tag_text").alias("e_tags"))
    df = notes.join(e, "memory_id").where(~F.col("e_text").eqNullSafe(F.col("text")) | ~F.col("e_tags").eqNullSafe(F.col("tag_text")))
    private = F.col("scope") == "private"
    return df.select("memory_id", F.coalesce("e_text", "text").alias("text"), (F.col("rev") + 1).alias("rev"), F.when(private, "private").otherwise("pending").alias("sync_state"), F.when(~private, "upsert").alias("op"))


#: The similarities of a rewording and of a follow-up, and how many of the nearest notes are looked at.
SAME, FOLLOWS, NEAREST = 0.97, 0.80, 3
#: Different vectors of an asset that one task compares with each other.
BLOCK = 2_000


class Known(NamedTuple):
    """An active note as a later one sees it."""

    cosine: float
    memory_id: int
    protected: bool
    private: bool


def settle(near: Iterable[Known], private: bool, resolves: bool, same: float) -> tuple[str, int | None]:
    """The outcome of a note, and the note it is held against, by the active notes that are alike, the nearest first.

    A reference note is never a duplicate's match nor replaced, but takes its
    place among the nearest. A private note replaces private ones only.
    """
    seen = list(itertools.islice(near, NEAREST))
    for k in seen:
        if k.cosine >= same and not k.protected:
            return "duplicate", k.memory_id
    target = next((k for k in seen if not k.protected), None)
    if target is None:
        return "stored", None
    if private and not target.private:
        return "guarded", target.memory_id
    return ("resolves" if resolves else "updates"), target.memory_id


REPLACES = ("updates", "resolves")
_OUTCOME = "memory_id long, asset string, private boolean, priority int, outcome string, other long"


def note_rows(notes: DataFrame) -> DataFrame:
    """memory_id, asset, at, embedding, private, protected, resolves and priority of notes to capture; scope, kind, text and priority may be missing."""
    has = lambda c, to: to if c in notes.columns else F.lit(False)
    flags = {
        "private": has("scope", F.coalesce(F.col("scope") == "private", F.lit(False))),
        "protected": has("kind", F.coalesce(F.col("kind") == "reference", F.lit(False))),
        "resolves": has("text", F.coalesce(says_resolved(F.col("text")), F.lit(False))),
        "priority": F.coalesce(F.col("priority").cast("int"), F.lit(0)) if "priority" in notes.columns else F.lit(0),
    }
    return notes.select(F.col("memory_id").cast("long"), F.col("asset").cast("string"), "at", F.col("embedding").cast("array<double>"), *(v.alias(k) for k, v in flags.items()))


def alike(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b and cosine (six places) of the different vectors of each asset, by their ``class``, at ``least`` or above; a = b for a vector with itself.

    An asset's vectors are dealt into parts of some ``block``, and a task
    compares two parts, so an asset with many notes is the work of many tasks.
    Copies of a vector are one class. Vectors of different length are not alike.
    """
    of = F.concat_ws(":", F.size("embedding").cast("string"), "asset")
    classes = rows.select("class", of.alias("of"), "embedding").dropDuplicates(["class"])
    classes = join_counted(classes, classes.groupBy("of").agg(F.count("*").alias("n")), "of", "n")
    classes = classes.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")).cast("int"))
    pairs = classes.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("of", F.least("part", "_with").alias("lo"), F.greatest("part", "_with").alias("hi"), "part", "class", "embedding")

    def compare(t: pa.Table) -> pa.Table:
        ids, parts = t["class"].to_numpy(), t["part"].to_numpy()
        vectors = np.asarray(t["embedding"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        one = parts[0] == parts[-1] and len(np.unique(parts)) == 1 and t["lo"][0].as_py() == t["hi"][0].as_py()
        left = np.arange(len(ids)) if one else np.flatnonzero(parts == t["lo"][0].as_py())
        right = left if one else np.flatnonzero(parts == t["hi"][0].as_py())
        out = []
        for lo in range(0, len(left), 256):
            some = left[lo : lo + 256]
            cos = np.round(vectors[some] @ vectors[right].T, 6)
            i, j = np.nonzero(cos >= least)
            use = ids[some[i]] <= ids[right[j]] if one else np.ones(len(i), dtype=bool)
            out.append((ids[some[i]][use], ids[right[j]][use], cos[i, j][use]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(dict(zip(("a", "b", "cosine"), columns, strict=True)))

    return pairs.groupBy("of", "lo", "hi").applyInArrow(compare, "a long, b long, cosine double")


class _Component:
    """The alike pairs and the active notes of one component."""

    def __init__(self, same: float):
        self.same, self.n = same, 0
        self.near: dict[int, dict[float, list[int]]] = {}
        self.order: dict[int, list[float]] = {}
        self.active: dict[int, list[tuple[int, int, bool, bool]]] = {}
        self.kinds: dict[int, int] = {}

    def link(self, kind: int, other: int, cosine: float) -> None:
        self.near.setdefault(kind, {}).setdefault(cosine, []).append(other)

    def add(self, i: int, kind: int, private: bool, protected: bool, resolves: bool) -> tuple[str, int | None]:
        near, active = self.near.get(kind, {}), self.active
        if kind not in self.order:
            self.order[kind] = sorted(near, reverse=True)
        known = (Known(c, *k[1:]) for c in self.order[kind] for k in heapq.merge(*(active[o] for o in near[c] if o in active)))
        outcome, other = settle(known, private, resolves, self.same)
        if outcome in REPLACES:
            of = self.kinds.pop(other)
            active[of] = [k for k in active[of] if k[1] != other]
            if not active[of]:
                del active[of]
        if outcome != "duplicate":
            active.setdefault(kind, []).append((self.n, i, protected, private))
            self.kinds[i] = kind
            self.n += 1
        return outcome, other


def outcomes(notes: DataFrame, same: float = SAME, follows: float = FOLLOWS, block: int = BLOCK) -> DataFrame:
    """memory_id, asset, private, priority, outcome (stored, duplicate, updates, resolves, guarded) and other for each note.

    Notes are taken in the order of ``at`` and memory_id. What was dropped or
    replaced before is no candidate later, so the outcome depends on all notes
    before; but only on those it is alike to, directly or through others. The
    alike pairs come first, and each component of them is then gone through in
    order by one task, which holds its pairs and the active notes' ids, no
    vectors. Of equal cosines the note that came first is nearer. Notes without
    an asset or a vector are stored. memory_id is unique.
    """
    of = F.when(F.col("asset").isNotNull() & F.col("embedding").isNotNull(), F.xxhash64("asset", "embedding"))
    rows = materialize(note_rows(notes).withColumn("class", of), "capture-notes")
    open_ = rows.where("class is not null")
    pairs = materialize(alike(open_, follows, block), "capture-pairs")
    label = connected_components(pairs.where("a <> b"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    place = nodes.join(label, "node", "left").select(F.col("node").alias("class"), F.coalesce("label", "node").alias("component"))
    place = materialize(place.join(open_.groupBy("class").agg(F.count("*").alias("n")), "class"), "capture-components")

    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("id"), "cosine").unionByName(pairs.where("a <> b").select(F.col("b").alias("class"), F.col("a").alias("id"), "cosine"))
    links = both.join(place.select("class", "component"), "class").withColumn("step", F.lit(0))
    told = join_counted(open_.drop("embedding"), place, "class", "n").withColumn("step", F.lit(1))
    members = told.where("component is not null").withColumnRenamed("memory_id", "id").drop("n")
    names = ["component", "class", "id", "cosine", "step", "asset", "private", "protected", "resolves", "priority"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, _Component(same)
        for b in batches:
            out = []
            for component, kind, i, cosine, step, asset, private, protected, resolves, priority in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if component != now:
                    now, fold = component, _Component(same)
                if step == 0:
                    fold.link(kind, i, cosine)
                else:
                    out.append((i, asset, private, priority, *fold.add(i, kind, private, protected, resolves)))
            columns = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["memory_id", "asset", "private", "priority", "outcome", "other"])

    folded = links.unionByName(members, allowMissingColumns=True).repartition("component").sortWithinPartitions("component", "step", "at", "id").mapInArrow(run, _OUTCOME)
    alone = told.where("component is null").unionByName(rows.where("class is null"), allowMissingColumns=True)
    return folded.unionByName(alone.select("memory_id", "asset", "private", "priority", F.lit("stored").alias("outcome"), F.lit(None).cast("long").alias("other")))


def capture(notes: DataFrame, same: float = SAME, follows: float = FOLLOWS, block: int = BLOCK) -> DataFrame:
    """``outcomes`` with what is written for each note: status, supersedes, superseded_by, rev, sync_state and op; nothing for a duplicate.

    A follow-up is linked with the note that it replaces, whose next revision
    says so; a guarded note leaves the other as it is. What is not private is
    queued once, whatever its revisions.
    """
    found = materialize(outcomes(notes, same, follows, block), "capture-outcomes")
    linked = F.col("outcome").isin(*REPLACES)
    by = found.where(linked).select(F.col("other").alias("memory_id"), F.col("memory_id").alias("superseded_by"))
    made, old = F.col("outcome") != "duplicate", F.col("superseded_by").isNotNull()
    return found.join(by, "memory_id", "left").withColumns(
        {
            "supersedes": F.when(linked, F.col("other")),
            "status": F.when(made, F.when(old, "superseded").otherwise("active")),
            "rev": F.when(made, F.when(old, 2).otherwise(1)),
            "sync_state": F.when(made, F.when(F.col("private"), "private").otherwise("pending")),
            "op": F.when(made & ~F.col("private"), "upsert"),
        }
    )


def captured_revisions(done: DataFrame) -> DataFrame:
    """memory_id, rev and note: the revisions that ``capture`` writes."""
    told = F.concat(F.lit("Replaced by a newer memory about "), "asset", F.lit("."))
    return done.where("rev is not null").select("memory_id", F.explode(F.sequence(F.lit(1), F.col("rev"))).alias("rev"), "asset").select("memory_id", "rev", F.when(F.col("rev") == 1, "Written here").otherwise(told).alias("note"))
