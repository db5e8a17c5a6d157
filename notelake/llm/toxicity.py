"""Toxicity by a linear classifier of character n-grams with naive Bayes scaling.

The features of a text are the character runs of ``LENGTHS`` within its
lower-cased words, where a word begins and ends with a blank; they are hashed
to ``SLOTS``. A feature's value grows with the share of words that hold it, as
ln(1 + ``STEEP`` x share), up to 1: a word that turns up once in a long text
says little. Of the labelled training rows Spark sums the values of each slot
by class. A slot's log-count ratio r is the log of its share
of the toxic counts over its share of the clean ones; of those with a ratio of
at least ``MARGIN`` the ``FEATURES`` slots with the largest chi-square are kept. A logistic
regression is fitted to the rows' kept features, each value times r, and its
log-odds are calibrated (Platt) on a sixth of the rows. All documents are then
scored in one pass over whole texts, without a shuffle, against a table of
fixed size.

Labels are learned from ``TOXIC`` and ``CLEAN`` rows at most, those of the
least hash of doc_id, and only from rows whose crc32 of doc_id leaves another
remainder than ``HELD`` by ``FOLDS``. Only texts are features.

Defined results: a null text is empty, and an empty one scores by the constant
alone; a null doc_id is not held out and lends no label; labels with a null are
not used; a document with several labels is toxic if any says so; of rows that
repeat a labelled doc_id the least text is fitted, and texts that agree are one
row; with fewer than ``LEAST`` rows of either class all scores are 0.5;
repeated rows are scored one by one; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.cotrain import Sparse, fit, platt, sigmoid
from notelake.llm.shingles import mix
from notelake.llm.words import CHUNK, chunks, gather, split_words, strings
from notelake.sources.scratch import materialize

LENGTHS, SLOTS, FEATURES = (2, 3, 4, 5, 6), 1 << 20, 4096
TOXIC, CLEAN, LEAST = 3_000, 6_000, 10
FOLDS, HELD, CUTOFF = 3, 1, 0.7
#: Of a word's share in a feature's value.
STEEP = 50
#: Least log-count ratio of a feature, to either side.
MARGIN = 1.0
#: Added to the counts of a slot in both classes.
SMOOTH = 0.5
#: Characters whose runs are hashed at once, and words whose runs are counted at once.
SLICE, TOKENS = 1 << 18, 1 << 15
_STEP, _BLANKS = np.uint64(0x100000001B3), np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)


def runs(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, slot) of every character run, a slice of the characters at a time; a place counts characters of the words, each behind a blank. White space in a word ends a run."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    longest = LENGTHS[-1]
    for lo in range(0, len(points) - 1, SLICE):
        part = points[lo : lo + SLICE + longest - 1]
        blank = np.isin(part, _BLANKS)
        code = np.where(blank, 32, part).astype(np.uint64)
        size = min(SLICE, len(part))
        hashed, inner = code[:size], np.ones(size, dtype=bool)
        for n in range(2, longest + 1):
            size = min(size, len(part) - n + 1)
            hashed = hashed[:size] * _STEP + code[n - 1 : n - 1 + size] + np.uint64(1)
            inner = inner[:size] & ~blank[n - 2 : n - 2 + size] if n > 2 else ~(blank[:size] & blank[1 : 1 + size])
            if n in LENGTHS:
                at = np.flatnonzero(inner)
                yield at + lo, (mix(hashed[at]) >> np.uint64(44)).astype(np.int32)


def features(texts: pa.Array, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) of the slots of each text, in order; of ``kept`` (a flag for each slot) only, if given."""
    found, bounds = split_words(pc.fill_null(texts, ""))
    words = [w.lower() for w in strings(found.dictionary)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    pairs = [np.zeros(0, dtype=np.int64)]
    for at, slot in runs(words):
        use = slice(None) if kept is None else np.flatnonzero(kept[slot])
        pairs.append(np.searchsorted(ends, at[use], side="right") * SLOTS + slot[use])
    pairs = np.unique(np.concatenate(pairs))
    slots, sizes = (pairs % SLOTS).astype(np.int32), np.bincount(pairs // SLOTS, minlength=len(words))
    codes, rows = np.asarray(found.indices), np.repeat(np.arange(len(texts)), np.diff(bounds))
    keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(codes), TOKENS):
        flat, at = gather(slots, sizes, codes[lo : lo + TOKENS])
        some = np.unique(np.repeat(rows[lo : lo + TOKENS], np.diff(at)) * SLOTS + flat, return_counts=True)
        keys.append(some[0])
        counts.append(some[1])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.diff(every[order], prepend=-1))
    own, n = every[order][first], np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    return own // SLOTS, own % SLOTS, np.minimum(1, np.log1p(STEEP * n / np.diff(bounds)[own // SLOTS]))


@dataclass
class Model:
    """A weight for each slot (0 where it is no feature), the constant, and the calibration."""

    weights: np.ndarray
    constant: float
    scale: tuple[float, float] = (1.0, 0.0)

    def score(self, texts: pa.Array) -> np.ndarray:
        row, slot, value = features(texts, self.weights != 0)
        a, c = self.scale
        return sigmoid(a * (np.bincount(row, weights=self.weights[slot] * value, minlength=len(texts)) + self.constant) + c)


def held_out(folds: int = FOLDS, held: int = HELD):
    """Whether a row of ``doc_id`` lends no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))


def _lists(row: np.ndarray, n: int, slots: np.ndarray, values: np.ndarray) -> list[pa.ListArray]:
    """The slots and the values of each of n rows, of which ``row`` has the numbers in order."""
    bounds = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(bounds, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(values, pa.float32()))]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, tuning, doc_id, slots and values for each labelled text that is fitted, written once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    some = materialize(some[0].unionByName(some[1]), "toxicity-labels")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # TOXIC + CLEAN rows at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    rows = rows.select("toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(6)) == 0).alias("tuning"), "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 2, CHUNK // 64):
            row, slot, value = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *_lists(row, b.num_rows, slot, value)], names=["toxic", "tuning", "doc_id", "slots", "values"])

    return materialize(rows.mapInArrow(run, "toxic int, tuning boolean, doc_id long, slots array<int>, values array<float>"), "toxicity-rows")


def ratios(rows: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """slot and its log-count ratio r for the ``FEATURES`` slots that tell the classes apart best, by the chi-square of their sums."""
    pairs = rows.where("not tuning").select("toxic", F.explode(F.arrays_zip("slots", "values")).alias("x")).select("toxic", "x.*")
    own = [F.sum(F.when(F.col("toxic") == y, (F.col("values") * 1e6).cast("long")).otherwise(0)) / 1e6 for y in (1, 0)]  # whole numbers, so that their order does not matter
    counts = pairs.groupBy(F.col("slots").alias("slot")).agg(own[0].alias("p"), own[1].alias("q"))
    counts = materialize(counts, "toxicity-counts")
    all_p, all_q = counts.agg(F.coalesce(F.sum("p"), F.lit(0)) + SMOOTH * SLOTS, F.coalesce(F.sum("q"), F.lit(0)) + SMOOTH * SLOTS).first()
    p, q = F.col("p"), F.col("q")
    apart = F.pow(p * n_clean - q * n_toxic, 2) / ((p + q) * (n_toxic + n_clean - p - q + 1))
    found = counts.select("slot", (F.log((p + SMOOTH) / all_p) - F.log((q + SMOOTH) / all_q)).alias("r"), apart.alias("apart"))
    return found.where(F.abs("r") >= MARGIN).orderBy(F.col("apart").desc(), "slot").limit(FEATURES).select("slot", "r")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit to the labelled rows; None where a class has too few."""
    rows = _labelled(docs, labels)
    sizes = {(r.toxic, r.tuning): r.n for r in rows.groupBy("toxic", "tuning").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get((y, False), 0) for y in (0, 1)) < LEAST:
        return None
    found = ratios(rows, sizes[1, False], sizes[0, False]).toArrow().sort_by("slot")  # FEATURES rows at most
    slots, r = found["slot"].to_numpy(), found["r"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(SLOTS, -1, dtype=np.int32)
        place[sent.value] = np.arange(len(sent.value), dtype=np.int32)
        for b in batches:
            at = place[np.asarray(b.column(3).flatten())]
            row = np.repeat(np.arange(b.num_rows), np.asarray(b.column(3).value_lengths()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *_lists(row[at >= 0], b.num_rows, at[at >= 0], np.asarray(b.column(4).flatten())[at >= 0])], names=["toxic", "tuning", "doc_id", "at", "values"])

    # TOXIC + CLEAN rows of FEATURES pairs at most.
    table = rows.mapInArrow(run, "toxic int, tuning boolean, doc_id long, at array<int>, values array<float>").toArrow().sort_by("doc_id").combine_chunks()
    y, tuning, lists = table["toxic"].to_numpy(), table["tuning"].to_numpy(), table["at"].combine_chunks()
    at = np.asarray(lists.flatten())
    value = np.asarray(table["values"].combine_chunks().flatten()) * r[at]
    scale = 1 / max(1.0, np.sqrt((value**2).sum() / max(1, len(y))))  # rows have a squared length of 1 on average
    x = Sparse(at, (value * scale).astype(np.float32), np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(lists.value_lengths())), len(y))
    base = np.flatnonzero(~tuning)
    w, b = fit(x.pick(base), y[base], len(slots))
    weights = np.zeros(SLOTS)
    weights[slots] = w * r * scale
    model = Model(weights, b)
    if min(sizes.get((k, True), 0) for k in (0, 1)) >= LEAST:
        model.scale = platt(x.dot(w)[tuning] + b, y[tuning])
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in chunks(batches, 2, CHUNK // 8):
            p = np.full(b.num_rows, 0.5) if m is None else m.score(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= CUTOFF).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` with a model trained on the labelled rows of ``docs``."""
    return score(docs, train(docs, labels))
