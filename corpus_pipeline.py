"""From raw documents to token shards, in five stages.

Each stage takes all rows that the one before kept, and all but the last return
the columns of ``documents``: quality rules drop rejected documents, near
duplicates leave one document of each class, contaminated documents go, the mix
takes blocks of words by source weight, and what is left is encoded into token
shards, whose documents are returned as read back from the files.

Defined results: a null or empty text fails the quality rules and goes; a null
doc_id, source or language is a value like any other; of rows equal in doc_id
and text one stays; other columns than those of ``documents`` are carried
through unchanged up to the mix, whatever their names; empty tables give no rows.
"""

import contextvars
import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notelake.llm import dart_minhash, decontaminate, mixing, quality_rules, token_planes
from notelake.sources.scratch import drop_paths, materialize, recording

#: Scratch paths of the stage before, for stages called one by one; each thread of work has its own.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def _own() -> list[str]:
    if _made.get() is None:
        _made.set([])
    return _made.get()


def _stage(f):
    """Drop the scratch tables of the stage before: its rows are written when this one begins."""

    @functools.wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _own())
        with recording(_own()):
            return f(spark, docs, sf_dir)

    return begin


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each near-duplicate class."""
    return dart_minhash.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share; a document taken twice is two rows."""
    return mixing.take(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards, which stay, and return doc_id, start, n_tokens and ids_crc32 from the files."""
    drop_paths(spark, _own())
    return token_planes.read_tokens(token_planes.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture), ("token-ID output", token_shards)]

#: The tokenizer and the template rules have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; what a stage leaves behind is dropped once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    outer = _made.set([])
    try:
        for name, stage in STAGES[:-1]:
            now, out = stage(spark, docs, sf_dir), []
            with recording(out):
                docs = materialize(now, name.replace(" ", "-"))
            drop_paths(spark, before)
            before = out
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _made.reset(outer)
