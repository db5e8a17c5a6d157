"""Chains of earlier versions by pointer doubling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.sources.scratch import materialize


def ancestors(notes: DataFrame, key: str = "memory_id", before: str = "supersedes", heads: DataFrame | None = None) -> DataFrame:
    """(head, node, depth) for each note (or each of ``heads``, a table with ``key``) and every earlier version of it, itself at depth 0; a chain that turns back on itself ends where it would repeat.

    Of rows that repeat a key that with the least ``before`` counts. Each round
    doubles the length of what is known, so a chain of n versions takes log2(n)
    rounds, each written to shared scratch space; a chain is rows, never one
    growing array, and only chains of the heads are followed.
    """
    rows = notes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(before).alias("next"))
    rows = materialize(rows, "chain-notes")
    known = rows.select(F.col("node").alias("next"))
    jump, span = materialize(rows.join(known, "next", "left_semi").select("node", "next"), "chain-jump"), 1  # where a note stands after ``span`` steps
    first = rows if heads is None else rows.join(heads.select(F.col(key).alias("node")).distinct(), "node", "left_semi")
    reach = materialize(first.select(F.col("node").alias("head"), "node", F.lit(0).cast("long").alias("depth")), "chain-reach")
    size = reach.count()
    while True:
        far = reach.join(jump, "node").select("head", F.col("next").alias("node"), (F.col("depth") + span).alias("depth"))
        reach = materialize(reach.unionByName(far).groupBy("head", "node").agg(F.min("depth").alias("depth")), "chain-reach")
        grown = reach.count()
        if grown == size:
            return reach
        size = grown
        jump = materialize(jump.withColumnRenamed("next", "mid").join(jump.select(F.col("node").alias("mid"), "next"), "mid").select("node", "next"), "chain-jump")
        span *= 2
