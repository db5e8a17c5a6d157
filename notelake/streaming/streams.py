"""Structured Streaming forms of the change feed, trust and the drain of a queue; ``stateful`` has the keyed state machines.

Each takes a streaming (or batch) frame and returns one; state is keyed, so it
is spread over the cluster.
"""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from notelake.sources.scratch import materialize, scratch_path

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_table(spark: SparkSession, sf_dir: str, name: str, exprs: list[str]) -> DataFrame:
    """A table of the folder as a file stream; times become timestamps, which event time needs."""
    path = f"{sf_dir}/{name}.parquet"
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        raw = files.parquet(path)
    else:
        raw = files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return raw.selectExpr(*exprs)


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, which the keyed state machines need."""
    spark.conf.set(*_STORE)


def run_to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = df.sparkSession
    keep_state_on_disk(spark)
    out = scratch_path(spark, "stream")
    writer = df.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").outputMode("append").start(out)
    else:
        # Updates of keyed state: each micro-batch is a versioned folder, and readers take the newest row of a key.
        q = writer.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    return spark.read.option("recursiveFileLookup", "true").schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(out)


def run_by_clock(df: DataFrame, out: str, every: str = "200 milliseconds", until: Callable[[], bool] | None = None, patience: float = 10) -> DataFrame:
    """Run a stream with timers of the clock, which never ends by itself, until a micro-batch takes nothing from the sources and ``until`` (if given) holds.

    Files without rows are something: what a micro-batch takes is told by the
    sources' offsets. A stream that has waited for ``patience`` seconds without a
    micro-batch (its source is empty) ends too; the time until it waits for the
    first time does not count.
    """
    spark = df.sparkSession
    keep_state_on_disk(spark)
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(processingTime=every).start(out)
    seen, since = None, None
    while q.isActive:
        last, status = q.lastProgress, q.status
        if last is not None and last["batchId"] != seen:
            seen, since = last["batchId"], None
        if status["isDataAvailable"]:
            since = None
        elif since is None and status["message"].startswith("Waiting"):
            since = time.monotonic()
        idle = last is not None and all(s["startOffset"] == s["endOffset"] for s in last["sources"]) or since is not None and time.monotonic() - since > patience
        if idle and (until is None or until()):
            break
        time.sleep(0.1)
    if (error := q.exception()) is not None:
        raise error
    q.stop()
    return spark.read.schema(df.schema).parquet(out)


def pull_changes(changes: DataFrame, late: str = "5 minutes") -> DataFrame:
    """A re-delivered (memory_id, rev) is dropped as long as it comes within the overlap.

    What lies further back than ``late`` behind the newest row is evicted from
    the state, and a row that comes later than that is left to the full listing.
    """
    return changes.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["memory_id", "rev"])


def trust(decisions: DataFrame, needed: int = 10) -> DataFrame:
    """Each device's run of approvals; a rejection starts it again."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (streak, seen) = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("decision_id")
        for ok in rows["approved"]:
            streak, seen = (streak + 1 if ok else 0), seen + 1
        state.update((streak, seen))
        yield pd.DataFrame({"device_id": [key[0]], "streak": [streak], "decisions": [seen], "trusted": [streak >= needed]})

    return decisions.groupBy("device_id").applyInPandasWithState(fold, "device_id string, streak long, decisions long, trusted boolean", "streak long, decisions long", "update", GroupStateTimeout.NoTimeout)


def drain(entries: DataFrame, out: str, cap: int) -> Callable[[DataFrame, int], None]:
    """The body of a ``foreachBatch`` that sends ``cap`` entries of each device in a micro-batch, the urgent ones first, and keeps the others.

    ``entries`` (the stream) has device_id, seq and priority. What waits is a
    table of its own for each micro-batch, so a micro-batch that runs again
    after a failure finds what it found before, and what it wrote is replaced.
    """
    spark, schema = entries.sparkSession, entries.schema

    def kept(n: int) -> DataFrame:
        path = f"{out}/waiting/{n}"
        return spark.read.schema(schema).parquet(path) if n >= 0 else spark.createDataFrame([], schema)

    def step(batch: DataFrame, n: int) -> None:
        every = materialize(batch.unionByName(kept(n - 1)), "drain")
        order = Window.partitionBy("device_id").orderBy(F.desc("priority"), "seq")
        ahead = every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
        ahead.write.mode("overwrite").parquet(f"{out}/sent/batch={n}")
        sent = spark.read.parquet(f"{out}/sent/batch={n}").select("device_id", "seq")
        every.join(sent, ["device_id", "seq"], "left_anti").write.mode("overwrite").parquet(f"{out}/waiting/{n}")

    return step


def drained(spark: SparkSession, out: str) -> DataFrame:
    """What ``drain`` has sent, with its micro-batch."""
    return spark.read.parquet(f"{out}/sent")
