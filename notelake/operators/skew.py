"""Joins with a table of one row for each key where few keys have most rows, and joins whose tasks stay small."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows is hot; hot keys that may be sent to every task.
HOT, MAX_HOT = 1_000, 200_000
#: Rows of a task of ``dealt``.
DEALT = 250_000


def join_counted(rows: DataFrame, table: DataFrame, on: str, n: str, hot: int = HOT, max_hot: int = MAX_HOT) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``on``; ``table`` has a row for each key and in ``n`` the key's rows.

    The entries of hot keys are sent to the tasks, so their rows are not
    shuffled; there are at most rows / ``hot`` of them, and they are counted.
    All other rows are joined by a shuffle. A null key joins nothing.
    """
    many = table.where(F.col(n) > hot)
    if not 0 < many.limit(max_hot + 1).count() <= max_hot:
        return rows.join(table, on, "left")
    marked = rows.join(F.broadcast(many.withColumn("_hot", F.lit(True))), on, "left")
    done = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").select(*rows.columns).join(table.where(F.col(n) <= hot), on, "left")
    return done.unionByName(rest)


def dealt(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``rows`` by ``key`` in so many partitions that a task gets some ``most`` of them, with the like share of what is joined on ``key`` after.

    The partitions of the session are a fixed number, so the sorts of a task
    would grow with the table. A table that they hold in parts of that size is
    left as it is. Keys are taken to have few rows each.
    """
    parts = -(-rows.count() // (most or DEALT))
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
