"""Places where a user's own model or rule enters."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.spans import resolve_spans


def embed(docs: DataFrame, key: str, model: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """key and vector: ``model`` gets a batch of texts and gives a vector for each; it is called in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "vector": model(b[text].fillna("").tolist())})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")


def add_names(raw: Column, names: Column) -> Column:
    """Detected spans (of ``raw_spans``) with a name model's (start, end) spans as persons."""
    return resolve_spans(raw, names)


def shared_words(query: Column, text: Column) -> Column:
    """The scorer where no model is given: the share of the query's different words that the text has."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), ""))
    return F.coalesce(F.size(F.array_intersect(words(query), words(text))) / F.nullif(F.size(words(query)), F.lit(0)), F.lit(0.0))


def rerank(results: DataFrame, scorer: Callable[[Column, Column], Column], head: int = 20, share: float = 0.6) -> DataFrame:
    """query_id, memory_id, score and place: the first ``head`` of each query (columns query, text, score) get a blend with the scorer's verdict, and the others keep their places behind them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    ranked = results.withColumn("was", F.row_number().over(order))
    first = ranked.where(F.col("was") <= head)  # only these rows reach the scorer
    first = first.withColumn("score", F.round((1 - share) * F.col("score") + share * scorer(F.col("query"), F.col("text")), 4)).withColumn("tail", F.lit(0))
    rest = ranked.where(F.col("was") > head).withColumn("tail", F.lit(1))
    fresh = Window.partitionBy("query_id").orderBy("tail", F.when(F.col("tail") == 0, -F.col("score")), "was")
    return first.unionByName(rest).select("query_id", "memory_id", "score", F.row_number().over(fresh).alias("place"))


def migrate(notes: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], version: str = "version") -> DataFrame:
    """Rows of an older version go through every step from theirs on; ``steps[n]`` brings version n to n + 1. Rows of a newer version are left out (held back)."""
    done = notes.where(F.col(version) == len(steps))
    for n in range(len(steps)):
        rows = notes.where(F.col(version) == n)
        for step in steps[n:]:
            rows = rows.transform(step)
        done = done.unionByName(rows.withColumn(version, F.lit(len(steps))), allowMissingColumns=True)
    return done
