"""An inverted-list index over vectors: a query looks into the lists nearest to it instead of at all rows.

The centroids are fitted on a bounded sample; every row is then put on the list
of its nearest centroid, by Spark. A search ranks the centroids for each query,
compares it with the rows of its first ``probes`` lists exactly, in blocks, and
keeps the best. With as many probes as lists the answer is that of all rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.retrieval import best, cosine_topk, nearest_within
from notelake.sources.scratch import materialize

#: Rows that the centroids are fitted on at most, rounds of fitting, and lists at most.
SAMPLE, ROUNDS, MAX_LISTS = 20_000, 10, 1_024
#: Rows whose nearest centroids a task looks up at once.
SLICE = 1_000


@dataclass
class Index:
    """centroids (a row each) and the table of list, vec_id and embedding."""

    centroids: np.ndarray
    rows: DataFrame


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit length by rounds of assignment and mean; a centroid that loses all rows takes the row furthest from its own."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near, cos = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for lo in range(0, len(x), SLICE):
            s = x[lo : lo + SLICE] @ c.T
            near[lo : lo + SLICE], cos[lo : lo + SLICE] = s.argmax(axis=1), s.max(axis=1)
        c = np.zeros_like(c)
        np.add.at(c, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        c[empty] = x[np.argsort(cos, kind="stable")[: len(empty)]]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _lists(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """vec_id, list, nth (0 for the nearest) and embedding: each row with the ``n`` lists nearest to it."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # MAX_LISTS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                x = np.asarray(part.column(1).flatten()).reshape(-1, c.shape[1])
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                place = pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(near.ravel().astype(np.int32)), place, part.column(1).take(at)], names=["vec_id", "list", "nth", "embedding"])

    return rows.mapInArrow(run, "vec_id long, list int, nth int, embedding array<double>")


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of all rows of ``vectors`` (vec_id, embedding), with the root of their number of lists if none is given.

    The sample is that of the least hashes of vec_id. Rows with a null id or
    vector, or whose vector is of another length than that of the least
    vec_id, are left out.
    """
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    head = rows.agg(F.min_by(F.size("embedding"), "vec_id").alias("width"), F.count("*").alias("n")).first()
    rows = rows.where(F.size("embedding") == (head.width or 0))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()  # ``sample`` rows
    x = np.asarray(some["embedding"].combine_chunks().flatten()).reshape(-1, head.width or 1)
    lists = min(lists or max(1, int(head.n**0.5)), MAX_LISTS, max(1, len(x)))
    centroids = _fit(x, lists) if len(x) else np.zeros((1, head.width or 1))
    return Index(centroids, materialize(_lists(rows, centroids, 1), "vector-lists"))


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, vec_id, score and place of the ``k`` best rows in the ``probes`` lists nearest to each query; a row is no answer to itself."""
    asked = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = materialize(_lists(asked.where(F.size("embedding") == index.centroids.shape[1]), index.centroids, probes), "vector-probes")
    found = nearest_within(asked, index.rows, "list", k, per=True)
    return best(found.drop("place"), "query_id", "vec_id", k)


def probes_for(index: Index, queries: DataFrame, k: int, target: float = 0.95, most: int = 200) -> int:
    """The fewest probes that find a share of ``target`` of the true ``k`` best rows, measured on at most ``most`` of the queries (those of the least hashes) against all rows."""
    lists = len(index.centroids)
    some = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    some = materialize(some.where(F.size("embedding") == index.centroids.shape[1]), "vector-tuning")
    exact = cosine_topk(some, index.rows.select("vec_id", "embedding"), k).join(index.rows.select("vec_id", "list"), "vec_id").select("query_id", "list")
    order = _lists(some, index.centroids, lists).select(F.col("vec_id").alias("query_id"), "list", (F.col("nth") + 1).alias("at"))  # most x lists rows
    at = exact.join(order, ["query_id", "list"]).select("at")
    found = at.agg(F.expr(f"percentile_disc({target}) within group (order by at)").alias("p")).first()
    return int(found.p or 1)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of ``exact`` (query_id, vec_id) that ``found`` has."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0))).first()[0]
