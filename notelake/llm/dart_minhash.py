"""Near duplicates by DartMinHash signatures.

Each element (a five-word shingle) with weight w owns the strip [0, w) of a
plane whose other axis is rank. Darts fall on the plane as a Poisson process
drawn by hashing the element and a dyadic cell, so equal elements get equal
darts in every document. A document keeps, for each of k coordinates, the
earliest dart in its own regions; two documents agree on a coordinate with the
probability of their weighted Jaccard similarity. Work follows the number of
elements plus k log k, not their product. The weight of a shingle grows with its letters from
1 to at most 1 + ``SPREAD``, the same in every document.

Bands of rows of the signature are joined by Spark. Work within a bucket stays
near its size: every member is compared with one centre, the member that meets
most others over all buckets; what these links have joined needs no further
comparison. Pairs in one bucket that are still in different classes, and
neither of which is the centre, are then tested inside the join condition,
which lets only true links out; a bucket of more than ``BLOCK`` members is
tested in pairs of blocks, so many tasks share it, but a family of pages that
are alike below the threshold still costs the square of its bucket. Links have a plain Jaccard similarity of at
least the threshold; classes are their connected components.

Defined results: words are runs without ASCII white space, lower-cased; a text
of one to four words is a single shingle; a null text or one without words is a
class of its own; byte-equal texts are one class whatever their doc_id, and
repeated rows each get a row; a null doc_id is carried, and is the class id
only where a class has no other; an empty table gives no rows; only doc_id and
text are read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.shingles import mix, shingle_set
from notelake.operators.components import connected_components
from notelake.operators.skew import join_counted
from notelake.sources.scratch import materialize

THRESHOLD = 0.8
#: Weights lie in a range of 1 to 1 + SPREAD, LONG letters have the top one.
SPREAD, LONG = 1 / 16, 64
#: A pair of plain similarity 0.8 has a weighted one of 0.8 / (0.8 + 0.2 (1 + SPREAD)) = 0.790 at least;
#: 62 bands of 7 find it with probability 1 - 2e-6, and one of 0.3 with 0.013.
BANDS, ROWS = 62, 7
#: Members of a bucket that one task compares with each other.
BLOCK = 500
_BASE = -4  # the first rank cell is [0, 2**-4)
_STRIPS = [(0.0, 1.0)] + [(float(2**v), float(2 ** (v + 1))) for v in range(7)]
_cdf: dict[float, np.ndarray] = {}


def _poisson(area: float) -> np.ndarray:
    """Cumulative Poisson probabilities, far enough out that the rest is below 1e-16."""
    if area not in _cdf:
        top = int(area + 12 * math.sqrt(area) + 24)
        i = np.arange(top + 1)
        logs = i * math.log(area) - area - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1)))))
        _cdf[area] = np.cumsum(np.exp(logs))
    return _cdf[area]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) ranks of the earliest dart for each coordinate; the rank names the dart. Documents without weight keep infinity."""
    sig = np.full(n_docs * k, np.inf)
    mass = np.bincount(owner, weights=weights, minlength=n_docs)
    reach = k * (math.log(k) + 2) / np.maximum(mass, 1e-300)
    live, level = mass > 0, _BASE - 1
    while live.any():
        lo, hi = (0.0, 2.0**_BASE) if level < _BASE else (2.0**level, 2.0 ** (level + 1))
        use = live[owner]
        e_all, w_all, o_all = elements[use], weights[use], owner[use]
        for v, (a, b) in enumerate(_STRIPS):
            some = w_all > a
            if not some.any():
                break
            e, w, o = e_all[some], w_all[some], o_all[some]
            cell = mix(e + np.uint64((((level + 64) << 8) + v) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            n = np.searchsorted(_poisson((b - a) * (hi - lo)), _unit(cell), side="right")
            at = np.repeat(np.arange(len(e)), n)
            if not len(at):
                continue
            j = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
            dart = mix(cell[at] + (j + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            inside = a + (b - a) * _unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) < w[at]
            at, dart = at[inside], dart[inside]
            rank = lo + (hi - lo) * _unit(dart)
            place = (mix(dart ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(sig, o[at] * k + place, rank)
        level += 1
        open_ = np.isinf(sig).reshape(n_docs, k).any(axis=1)
        live &= (reach > hi) | open_
    return sig.reshape(n_docs, k)


def weights(letters: np.ndarray) -> np.ndarray:
    """Weights of shingles, scaled so that the top one is 1: similarities do not change by that."""
    return (1 + SPREAD * np.minimum(letters, LONG) / LONG) / (1 + SPREAD)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_docs, bands) signed 64-bit keys."""
    x = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), x.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return h.view(np.int64)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, key (of the text), sh (distinct shingles, 32 bits each, sorted) and bands, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                sets = [shingle_set((t or "").lower().encode().split()) for t in b.column(2).to_pylist()]
                sizes = np.array([len(s) for s, _ in sets])
                owner = np.repeat(np.arange(len(sets)), sizes)
                sig = dart_signatures(np.concatenate([s for s, _ in sets]), weights(np.concatenate([c for _, c in sets])), owner, len(sets), bands * rows)
                keys = band_keys(sig, bands, rows)
                keys = [k if n else k[:0] for k, n in zip(keys, sizes, strict=True)]
                small = [np.unique((s >> np.uint64(32)).astype(np.uint32).view(np.int32)) for s, _ in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(small, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "sh", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("key"), "text")
    signed = rows_.mapInArrow(run, "doc_id long, key binary, sh array<int>, bands array<long>")
    return materialize(signed.select(F.monotonically_increasing_id().alias("rid"), "*"), "signatures")


def _similar(a: str, b: str, threshold: float):
    both = F.size(F.array_intersect(a, b))
    na, nb = F.size(a), F.size(b)
    return (na >= threshold * nb) & (nb >= threshold * na) & (both / (na + nb - both) >= threshold)


def classes(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rid, doc_id, key, class_id, class_size and kept for each row of ``signed``; kept marks the row of the least doc_id."""
    wordy = signed.where(F.size("sh") > 0)
    first = materialize(wordy.groupBy("key").agg(F.min("rid").alias("node"), F.count("*").alias("n")).where("n > 1"), "copies")
    member = join_counted(signed.select("rid", "doc_id", "key"), first, "key", "n")
    member = materialize(member.select("rid", "doc_id", "key", F.coalesce("node", "rid").alias("node")), "members")
    banded = signed.select("rid", "bands").join(member.where("rid = node").select("rid"), "rid", "left_semi").select(F.col("rid").alias("node"), F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(banded.join(sizes, "band"), "met")
    score = met.groupBy("node").agg(F.sum("size").alias("score"))
    centre = met.join(score, "node").groupBy("band").agg(F.max_by("node", F.struct(F.col("score"), -F.col("node"))).alias("centre"))
    spokes = materialize(met.join(centre, "band").where("node <> centre").select("band", "node", "centre"), "spokes")
    texts = materialize(signed.select(F.col("rid").alias("node"), "sh").join(met.select("node").distinct(), "node", "left_semi"), "met-shingles")

    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("sh").alias(f"sh_{name}"))

    pairs = spokes.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_similar("sh_a", "sh_b", threshold)).select("a", "b")
    near = materialize(near, "links")
    label = connected_components(near)

    # What the centres leave apart: tested within its buckets, and only across classes.
    apart = spokes.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    split = apart.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    left = apart.join(split, "band", "left_semi")
    size = left.groupBy("band").agg(F.count("*").alias("n"))
    blocked = join_counted(left, size, "band", "n").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = materialize(blocked.join(texts, "node").select("band", "blocks", "block", "node", "label", "sh"), "apart")
    x = left.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1))).select("band", "block", "other", "label", "sh").alias("x")
    y = left.withColumn("other", F.explode(F.sequence(F.lit(0), "block"))).select("band", F.col("other").alias("block"), F.col("block").alias("other"), "label", "sh").alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.other") == F.col("y.other"))
    across = F.when(F.col("x.block") == F.col("x.other"), F.col("x.label") < F.col("y.label")).otherwise(F.col("x.label") != F.col("y.label"))
    cross = x.join(y, same & across & _similar("x.sh", "y.sh", threshold))
    more = materialize(cross.select(F.least("x.label", "y.label").alias("a"), F.greatest("x.label", "y.label").alias("b")).distinct(), "links")
    label = connected_components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    placed = member.join(label, "node", "left").select("rid", "doc_id", "key", F.coalesce("label", "node").alias("component"))
    of = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))["rid"].alias("first_rid"))
    classed = join_counted(materialize(placed, "placed"), materialize(of, "classes"), "component", "class_size")
    return classed.select("rid", "doc_id", "key", "class_id", "class_size", (F.col("rid") == F.col("first_rid")).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and kept for each row of ``docs``."""
    return classes(sign(docs), threshold).select("doc_id", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` less all but one of each class, with their own columns; rows without words all stay."""
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))
    has = F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    wordy = docs.where(has)
    kept = classes(sign(wordy), threshold).where("kept").select(F.concat_ws(":", F.col("doc_id").cast("string"), F.lower(F.hex("key"))).alias("at"))
    # Of rows equal in doc_id and text one stays, the least by the hash of all columns; they are combined before the shuffle.
    one = wordy.select(key.alias("at"), row.alias("row"), F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in columns)).alias("rank")).groupBy("at").agg(F.min_by("row", "rank").alias("row"))
    return one.join(kept, "at", "left_semi").select("row.*").unionByName(docs.where(~has))


def sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL: all pairs by shared shingles, then components."""
    return rf"""
with recursive t as (select row_number() over () as r, doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from documents),
d as (select min(r) as node, text, any_value(w) as w from t where len(w) > 0 group by text),
s as (select distinct node, g from (select node, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d)),
n as (select node, count(*) as n from s group by node),
p as (select a.node as a, b.node as b, count(*) as c from s a join s b on a.g = b.g and a.node < b.node group by all),
e as (select a, b from p join n x on x.node = a join n y on y.node = b where c / (x.n + y.n - c) >= {threshold}),
both_ways as (select a, b from e union all select b, a from e),
reach as (select node, node as label from d union select b, label from reach join both_ways on a = node),
comp as (select node, min(label) as component from reach group by node),
m as (select t.r, t.doc_id, coalesce(comp.component, -t.r) as component from t left join d on t.text = d.text left join comp on comp.node = d.node)
select doc_id, min(doc_id) over (partition by component) as class_id, count(*) over (partition by component) as class_size,
  row_number() over (partition by component order by doc_id nulls last, r) = 1 as kept from m"""
