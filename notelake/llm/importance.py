"""Importance resampling towards a target distribution.

Words come from bytes: a 256-byte table turns capitals A-Z into small letters
and all separators into blanks, and ``bytes.split`` yields the words. The
features of a text are its runs of 1 to ``n`` words; a run's crc32 is that of
the shorter run, used as the seed, extended by a blank and the next word. A
document's Counter of features is reduced to hashed buckets. Bucket counts of
the raw and of the target texts give each bucket a log ratio (its gain), the
sum of gains over a document's features is its weight, and the documents with
the highest weight plus Gumbel noise, which is hashed from doc_id, are drawn:
a draw without replacement in proportion to the importance weights.

Texts are read twice, for the bucket counts and for the weights; what tasks
send on is a row for each bucket, then a row of numbers for each document. The
drawn order is global: documents are dealt out by ranges of their score, and a
document's rank is its place in its range after the sizes of those before.

Defined results: a null or empty text has no features and weight 0; only
documents of at least ``LEAST`` words are drawn; a null doc_id hashes like an
empty one and comes after the others of its score; rows that repeat a doc_id
are separate documents, and those that agree in all columns take the ranks next
to each other; an empty target or corpus counts 0 in every bucket; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.words import chunks
from notelake.operators.ranks import ranked
from notelake.sources.scratch import materialize

N, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text``, in lists for ``PIECE`` bytes each."""
    text, lo = text.translate(_TABLE), 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def features(text: bytes, n: int = N) -> Iterator[tuple[int, list[int]]]:
    """(length of the runs, their crc32) for runs of 1 to n words, a piece of the text at a time."""
    before: list[bytes] = []
    for new in _pieces(text):
        words, old = before + new, len(before)
        runs = list(map(crc32, words))
        yield 1, runs[old:]
        tails = [b" " + w for w in words] if n > 1 else []
        for k in range(1, n):
            runs = list(map(crc32, tails[k:], runs))
            yield k + 1, runs[max(0, old - k) :]  # those that end in a new word
        before = words[-(n - 1) :] if n > 1 else []


def _counted(text: bytes, n: int) -> tuple[int, Counter]:
    """(words, the Counter of a text's features by crc32)."""
    n_words, found = 0, Counter()
    for k, runs in features(text, n):
        n_words += len(runs) if k == 1 else 0
        found.update(runs)
    return n_words, found


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (v.as_py() or b"" for v in column.cast(pa.binary()))


def bucket_counts(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in chunks(batches, 0):
            for text in _bytes(b.column(0)):
                found = _counted(text, n)[1]
                if found:
                    at = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % buckets
                    total += np.bincount(at, weights=np.fromiter(found.values(), dtype=np.int64, count=len(found)), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """Each bucket's log ratio of target to raw, in thousandths, with one added to every count."""
    s_all, t_all = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, hashed from seed and doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score for each row of ``docs``, written once."""
    sent = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in chunks(batches, 1):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), _bytes(b.column(1)), strict=True):
                n_words, found = _counted(text, n)
                weight = sum(gain[f % buckets] * c for f, c in found.items())
                rows.append((doc_id, n_words, found.total(), weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCORED), "importance")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) for each row of ``docs``."""
    scored = weigh(docs, target, n, buckets, seed)
    names = ["doc_id", "n_features", "weight", "score"]
    long = F.col("n_words") >= least
    drawn, total = ranked(scored.where(long).select(*names), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= total * percent // 100, F.col("rank")))
    return drawn.select(*names, "rank").unionByName(scored.where(~long).select(*names, F.lit(None).cast("long").alias("rank")))


def sql(buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> str:
    """DuckDB SQL for the query's columns, for single words; crc32 goes byte by byte over a table made from its polynomial."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with recursive d as (select row_number() over () as rid, doc_id, {words} as words from documents),
w as (select rid, unnest(words) as w from d),
b as (select unnest({words}) as w from benchmark),
steps(i, c, k) as (select i, i, 0 from (select unnest(range(256)) as i) union all select i, case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from steps where k < 8),
tab as (select list(c order by i) as tab from steps where k = 8),
vocab as (select w, hex(encode(w)) as hx from (select w from w union select w from b)),
crc as (select w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint)), lambda c, x: xor(tab[xor(c & 255, x) + 1], c >> 8))) % {buckets} as bucket from vocab, tab),
s as (select bucket, count(*) as n from w join crc using (w) group by bucket),
t as (select bucket, count(*) as n from b join crc using (w) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {buckets})::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + {buckets})::double)))::bigint as gain from (select distinct bucket from crc) left join s using (bucket) left join t using (bucket)),
own as (select rid, count(*)::bigint as n_features, sum(gain)::bigint as weight from w join crc using (w) join g using (bucket) group by rid),
e as (select rid, doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join own using (rid)),
f as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from e),
r as (select rid, row_number() over (order by score desc, doc_id nulls last, n_features) as rank, count(*) over () as total from f where n_features >= {least})
select doc_id, n_features, weight, score, case when rank <= total * {percent} // 100 then rank end as rank from f left join r using (rid)"""
