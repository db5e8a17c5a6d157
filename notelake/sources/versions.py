"""State tables on plain Parquet: each write is a new version, and readers take the newest.

Parquet has no MERGE; an upsert is a union with the newest row of each key,
written to a folder of its own. A version becomes one by its commit, a small
file ``commits/<number>`` that names the folder and is created only if it is
not there yet, so of two writers that began from the same version one commits
and the other begins anew from what the first has written. A reader never sees
half a write. Creating a file only if it is absent is atomic on HDFS and its
like; a store that cannot do that needs one writer at a time.
"""

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.filters import latest
from notelake.sources.scratch import drop_paths

#: Times that an upsert begins anew when another writer was first.
TRIES = 20


class Conflict(Exception):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(spark: SparkSession, root: str, n: int) -> str:
    """The folder that commit ``n`` names, empty while its writer is about to."""
    at, fs = _fs(spark, f"{root}/commits/{n:010d}")
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return "".join(chr(stream.read()) for _ in range(size))
    finally:
        stream.close()


def newest(spark: SparkSession, root: str) -> int:
    """The newest complete version, or 0."""
    at, fs = _fs(spark, f"{root}/commits")
    if not fs.exists(at):
        return 0
    found = sorted((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), reverse=True)
    return next((n for n in found if _folder(spark, root, n)), 0)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version, the newest if none is given."""
    return spark.read.parquet(f"{root}/data/{_folder(spark, root, version or newest(spark, root))}")


def write(df: DataFrame, root: str, base: int | None = None) -> int:
    """Write the version after ``base`` (the newest if none is given) and return its number; ``Conflict`` if another writer was first."""
    spark = df.sparkSession
    n = (newest(spark, root) if base is None else base) + 1
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{name}")
    at, fs = _fs(spark, f"{root}/commits/{n:010d}")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        drop_paths(spark, [f"{root}/data/{name}"])
        if "AlreadyExists" in str(e.java_exception):
            raise Conflict(f"version {n} of {root}") from None
        raise
    out.write(bytearray(name, "ascii"))
    out.close()
    return n


def upsert(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> int:
    """Replace or add ``rows`` by key, leave out the keys of ``deleted``, and write the next version; begins anew if another writer was first."""
    for turn in range(TRIES):
        base = newest(spark, root)
        new = rows.withColumn("_age", F.lit(0))
        if base:
            new = new.unionByName(read(spark, root, base).withColumn("_age", F.lit(1)))
        out = latest(new, keys, "_age").drop("_age")
        try:
            return write(out.join(deleted, keys, "left_anti") if deleted is not None else out, root, base)
        except Conflict:
            time.sleep(0.05 * (turn + 1))
    raise Conflict(f"{TRIES} tries on {root}")


def write_lines(df: DataFrame, line: str, order: list[str], path: str) -> None:
    """One text line for each row, sorted over ranges, so that the files in name order are in order."""
    df.orderBy(*order).select(line).write.text(path)
