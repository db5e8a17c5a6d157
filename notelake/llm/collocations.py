"""Phrase collocations by dynamic itemset counting.

Texts are cut into pieces at marks and line ends, and pieces into words; a
phrase is a run of 1 to ``LONGEST`` words of a piece, and languages are counted
apart. The texts are encoded once into blocks (the different words of a block,
and its text as numbers of words), which are dealt out over ``SHARDS`` shards.
Steps scan one shard after the other, round and round. A word is counted from
the first step on. A longer phrase is counted from the step after that in which
both its subphrases (without the last and without the first word) have reached
the threshold in the counts so far, and for one full cycle of shards, so its
count is then that of all texts. Lengths are so counted side by side, and only
phrases whose subphrases are frequent are counted at all.

Counts are summed by Spark from rows that each block has summed before; a
phrase that ends its cycle below the threshold leaves the table. Tasks learn
which phrases have reached the threshold, and when, from a table of ``SLOTS``
bytes for each length, which phrases are hashed into: its size is fixed, and two
phrases that share a slot only make longer ones be counted that need not be: a
longer one never begins before its own subphrases are counted.

A candidate's score is that of its weakest cut into two phrases; candidates
that stand nearly always inside a longer one are dropped, and each language's
top is taken in two rounds, so no task sorts all phrases of a language.

Defined results: a null text is empty; a null language is ``und``, together
with rows that say so; repeated rows count each time; ties of scores go by
count, then phrase; an empty table gives no rows; only text and lang are read.
A block holds whole pieces, so a text without marks or line ends is one block.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.llm.shingles import _ODD, mix
from notelake.llm.words import chunks
from notelake.sources.scratch import drop_paths, materialize, recording, scratch_path

LONGEST, THRESHOLD, SHARDS = 4, 30, 3
INSIDE, TOP, SCALE = 80, 2_000, 2_000_000
#: Bytes of text in a block; bytes of the table of frequent phrases of a length.
BLOCK, SLOTS = 8 << 20, 1 << 23
#: In that table: no phrase has reached the threshold.
NEVER = 255
#: Tasks that share a language's candidates in the first round.
PARTS = 64
_BREAKS = {*b".,;:!?", *range(10, 14)}
_TABLE = bytes(10 if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNTS = "lang string, n int, phrase string, start int, f long"


class _Codes(dict):
    """Numbers of words from 1 as they turn up; 0 is a line end, what is between two blanks is none."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self) - 1
        return code


def _cut(data: bytes, block: int) -> Iterator[bytes]:
    """``data`` in parts of some ``block`` bytes that end at a line end."""
    lo = 0
    while lo < len(data):
        hi = data.rfind(b"\n", lo + 1, lo + block) if len(data) - lo > block else len(data)
        hi = hi if hi > 0 else data.find(b"\n", lo + block)
        hi = hi if hi > 0 else len(data)
        yield data[lo:hi]
        lo = hi


def blocks(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """shard, lang, size (words), words (the different ones, a line each) and codes (little-endian 32-bit numbers of words from 1, 0 between pieces), written once by shard."""
    kinds = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("size", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for b in chunks(batches, 1, block):
            langs, texts = b.column(0).dictionary_encode(), b.column(1).cast(pa.binary())
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = texts.filter(pc.equal(langs.indices, k)).to_pylist()
                for part in _cut(b"\n".join(own).translate(_TABLE), block):
                    codes, tokens = _Codes(), part.replace(b"\n", b" \n ").split(b" ")
                    found = np.fromiter(map(codes.__getitem__, tokens), dtype=np.int32, count=len(tokens))
                    found = found[found >= 0]
                    words = list(codes)[2:]
                    if words:
                        shard += 1
                        yield pa.RecordBatch.from_pylist([{"shard": shard % shards, "lang": lang, "size": int((found > 0).sum()), "words": b"\n".join(words), "codes": found.astype("<i4").tobytes()}], schema=kinds)

    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "phrase-blocks")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(run, "shard int, lang string, size long, words binary, codes binary").write.option("parquet.page.size.row.check.min", "2").partitionBy("shard").parquet(path)
    return spark.read.schema("lang string, size long, words binary, codes binary, shard int").parquet(path)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    h, lead = xxhash.xxh3_64_intdigest, lang.encode() + b"\n"
    return np.fromiter((h(lead + w) for w in words), dtype=np.uint64, count=len(words))


def _slots(hashes: list[np.ndarray], slots: int) -> np.ndarray:
    """Which of ``slots`` each phrase has, of whose j-th words the hashes are in ``hashes[j]``."""
    total = np.zeros(len(hashes[0]), dtype=np.uint64)
    for j, h in enumerate(hashes):
        total += mix(h + _ODD[j]) * _ODD[j]
    return (mix(total) % np.uint64(slots)).astype(np.int64)


def count_block(lang: str, words: list[bytes], codes: np.ndarray, reached: list[np.ndarray], step: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, words of each phrase, start, count) of a block's phrases that are counted in ``step``.

    ``reached[n - 1]`` has for each slot the step in which a phrase of n words
    there reached the threshold. A place holds the step of the phrase that
    begins there, and that phrase's number among the block's different ones.
    """
    hashes = np.concatenate((np.zeros(1, dtype=np.uint64), _word_hashes(lang, words)))
    if step < shards:
        found = np.bincount(codes, minlength=len(hashes))[1:]
        yield 1, np.arange(1, len(hashes))[:, None], np.zeros(len(words), dtype=np.int32), found
    since = np.append(np.uint8(NEVER), reached[0][_slots([hashes[1:]], len(reached[0]))])[codes].astype(np.int32)  # a line end never
    number, most = codes.astype(np.int64), len(hashes)
    for n in range(2, LONGEST + 1):
        start = np.maximum(since[:-1], since[1:]) + 1
        at = np.flatnonzero(start <= step)  # both subphrases are there
        # The subphrases that begin at a place and at the next give the phrase its number.
        found, first, back, counts = np.unique(number[at] * most + number[at + 1], return_index=True, return_inverse=True, return_counts=True)
        own = codes[at[first][:, None] + np.arange(n)]
        begun = start[at[first]]
        now = begun + shards > step
        yield n, own[now], begun[now], counts[now]
        if n == LONGEST or not len(at):
            return
        since, number, most = np.full(len(start), NEVER, dtype=np.int32), np.zeros(len(start), dtype=np.int64), len(found)
        # A slot that was marked before the phrase was counted is another's; longer ones wait until this one is there.
        since[at] = np.maximum(reached[n - 1][_slots(list(hashes[own].T), len(reached[0]))], begun)[back]
        number[at] = back


def _scan(part: DataFrame, sent: Broadcast, step: int, shards: int) -> DataFrame:
    """lang, n, phrase, start and f (in each block) of what is counted in ``step``; ``sent`` has the packed tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = [np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in sent.value]
        for b in batches:
            for lang, packed, codes in zip(*(b.column(k) for k in range(3)), strict=True):
                lang, words = lang.as_py(), packed.as_py().split(b"\n")
                pool = pa.array([b"", *words])
                for n, own, start, counts in count_block(lang, words, np.frombuffer(codes.as_py(), dtype="<i4"), reached, step, shards):
                    phrase = pc.binary_join_element_wise(*(pool.take(pa.array(own[:, j])) for j in range(n)), b" ")
                    size = len(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.full(size, n, np.int32)), phrase.cast(pa.string()), pa.array(start, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "n", "phrase", "start", "f"])

    return part.select("lang", "words", "codes").mapInArrow(run, _COUNTS)


def _mark(reached: list[np.ndarray], new: DataFrame, step: int) -> set[int]:
    """Note ``step`` in the slots of the phrases of ``new``; the lengths at which it has some."""
    size = len(reached[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, lengths, phrases = (b.column(k).to_pylist() for k in range(3))
            hashes = [_word_hashes(lang, p.encode().split(b" ")) for lang, p in zip(langs, phrases, strict=True)]
            slots = [int(_slots([h[j : j + 1] for j in range(len(h))], size)[0]) for h in hashes]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(slots, pa.int32())], names=["n", "slot"])

    found = new.select("lang", "n", "phrase").mapInArrow(run, "n int, slot int").distinct().toArrow()  # a row for each slot and length at most
    lengths, slots = found["n"].to_numpy(), found["slot"].to_numpy()
    for n in range(1, LONGEST):
        own = slots[lengths == n]
        reached[n - 1][own[reached[n - 1][own] == NEVER]] = step
    return set(lengths.tolist())


def phrase_counts(spark: SparkSession, stored: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """lang, n, phrase and f for each phrase of 1 to ``LONGEST`` words that stands ``threshold`` times or more in the blocks."""
    reached = [np.full(slots, NEVER, dtype=np.uint8) for _ in range(LONGEST - 1)]
    table, old, step, end = spark.createDataFrame([], f"{_COUNTS}, before long"), [], 0, shards
    while step < end:
        sent, made = spark.sparkContext.broadcast([zlib.compress(x, 1) for x in reached]), []
        scanned = _scan(stored.where(F.col("shard") == step % shards), sent, step, shards)
        rows = table.select("lang", "n", "phrase", "start", "f", F.col("f").alias("before")).unionByName(scanned.withColumn("before", F.lit(0).cast("long")))
        rows = rows.groupBy("lang", "n", "phrase").agg(F.min("start").alias("start"), F.sum("f").alias("f"), F.sum("before").alias("before"))
        with recording(made):
            table = materialize(rows.where((F.col("f") >= threshold) | (F.col("start") + shards - 1 > step)), "phrase-counts")
        sent.destroy()  # what was counted with it is written
        drop_paths(spark, old)
        old = made
        new = table.where((F.col("f") >= threshold) & (F.col("before") < threshold) & (F.col("n") < LONGEST))
        if _mark(reached, new, step):
            end = step + 1 + shards  # what these begin has seen all shards then
        step += 1
    return table.where(F.col("f") >= threshold).select("lang", "n", "phrase", "f")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, inside: int = INSIDE, shards: int = SHARDS, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases."""
    spark = docs.sparkSession
    stored = blocks(docs, shards, block)
    counts = phrase_counts(spark, stored, threshold, shards, slots)
    words = F.split("phrase", " ")
    run = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    found = counts.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), "n", words.alias("words"))

    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("first"), run(F.col("k") + 1, F.col("n") - F.col("k")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div cast(l + r as decimal(20, 0))")
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"), F.first("a").alias("a"))

    longer = found.where("n > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)))
    longer = longer.select("lang", run(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    kept = kept.withColumn("_place", place("lang", "_part")).where(F.col("_place") <= top)
    kept = kept.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)  # PARTS x top rows of a language
    sizes = stored.groupBy("lang").agg(F.sum("size").alias("n"))
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(threshold: int = THRESHOLD, top: int = TOP, inside: int = INSIDE) -> str:
    """DuckDB SQL for the query's columns, which counts all phrases."""
    return rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
g as ({' union all '.join(f"select lang, {k} as k, unnest(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' '))) as phrase from w where len(words) >= {k}" for k in range(1, LONGEST + 1))}),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= {threshold}),
c as (select lang, phrase, f as a, k as size, string_split(phrase, ' ') as words from f where k > 1),
cut as (select *, unnest(range(1, size)) as j from c),
s as (select cut.lang, cut.phrase, a, j, x.f as l, y.f as r, (a::hugeint * {SCALE}) // (x.f + y.f) as score from cut
  join f x on x.lang = cut.lang and x.phrase = array_to_string(words[1:j], ' ') join f y on y.lang = cut.lang and y.phrase = array_to_string(words[j + 1:size], ' ')),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i1 as (select lang, a, size, words, unnest(range(2, size)) as n from c where size > 2),
i2 as (select *, unnest(range(1, size - n + 2)) as j from i1),
i as (select lang, array_to_string(words[j:j + n - 1], ' ') as phrase, max(a) as most from i2 group by all),
t as (select lang, sum(len(words))::bigint as n from w group by lang)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
  from low left join i using (lang, phrase) join t using (lang) where most is null or 100 * most < {inside} * a) where rank <= {top}"""
