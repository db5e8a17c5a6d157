"""Places in a global order, without one task that sorts all rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.sources.scratch import materialize


def ranked(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """(``rows`` of a written table with ``rank``, their place in ``order`` from 1; how many there are).

    Rows are dealt out by ranges of ``order``, and a row's rank is its place in
    its range after the sizes of those before. Rows that agree in all of
    ``order`` are dealt out by a last key of their own, so none of the ranges
    is crowded.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.monotonically_increasing_id()
    dealt = rows.withColumn("_row", own).repartitionByRange(parts, *order, F.col("_row")).sortWithinPartitions(*order, F.col("_row")).drop("_row")
    dealt = materialize(dealt.withColumn("_at", own), "ranked-ranges")  # the partition in the upper bits, the place in it below
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "ranked-sizes")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    placed = dealt.withColumn("_part", part).join(F.broadcast(sizes.select("_part", "_before")), "_part")
    return placed.withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at"), total
