"""A quality classifier by co-training two views.

The content view is a linear model of hashed words and word shapes of the text;
the page view one of metadata alone: source, language and length. Each is first
fitted to the labelled training rows. In every round both score all documents
on Spark, and of those that a view is sure of the surest in each stratum (a
hash cell of source and language) and class join the *other* view's training
rows. The labelled rows are dealt by hash: four sixths train, one calibrates
each view (Platt), and on the last the cutoff of the added calibrated log-odds
(less the prior) is set where ``MAX_LOSS`` of its good rows fall below.

Fitting sees at most ``LABELLED`` labelled rows, chosen by the hash of doc_id,
and in each round at most ``PSEUDO`` pseudo-labelled ones a view, chosen from
all documents; what comes to the driver is bounded by rows, as one row stands
for all that repeat a doc_id and text. Whole texts are read once: each
document's hashed words with their counts are written to shared scratch space,
and the rounds and the last scoring read these against weights of fixed size.

Defined results: a null text is empty and its content score is the prior; null
source, language or n_chars are values of their own; a document with several
labels is good if any says so, and null labels are not used; of rows that
repeat a labelled doc_id with other texts, one is fitted; with fewer than
``LEAST`` rows of either class all scores are 0.5 and all rows are kept;
repeated rows are scored one by one; an empty table gives no rows; columns
other than doc_id, text, source, lang and n_chars are not read.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.llm.words import CHUNK, chunks, gather, split_words, strings
from notelake.sources.scratch import materialize

LABELLED, PSEUDO, LEAST = 5_000, 2_000, 20
ROUNDS, SURE, CELLS = 3, 0.95, 16
MAX_LOSS = 0.005
WORDS, SHAPES, PAGE = 1 << 14, 1 << 10, 1 << 10
#: Weight of a text's shapes beside its words.
SHAPE_SCALE = 4.0
_UP, _LOW, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+"), re.compile(r"\d+")


def _slot(text: str, size: int, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text, seed) % size


def word_slots(word: str) -> tuple[int, int]:
    """The hashed word and its shape: runs of capitals, small letters and digits shrink to A, a and 0, marks stay."""
    shape = _LOW.sub("a", _UP.sub("A", _DIGIT.sub("0", word)))[:12]
    return _slot(word.lower(), WORDS, 1), _slot(shape, SHAPES, 2)


def page_slots(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Hashed metadata; the length goes to steps of powers of two."""
    size = "-" if n_chars is None else int(np.log2(max(1, n_chars)))
    return [_slot(v, PAGE, 3) for v in (f"source={source}", f"lang={lang}", f"chars={size}", f"source={source} lang={lang}")]


@dataclass
class Sparse:
    """Rows of (slot, value) pairs, end to end."""

    slot: np.ndarray
    value: np.ndarray
    row: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.slot], minlength=self.n)

    def pick(self, rows: np.ndarray) -> "Sparse":
        to = np.full(self.n, -1, dtype=np.int32)
        to[rows] = np.arange(len(rows), dtype=np.int32)
        use = to[self.row] >= 0
        return Sparse(self.slot[use], self.value[use], to[self.row[use]], len(rows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: Sparse, y: np.ndarray, size: int, steps: int = 120, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with balanced classes, by Adam on all rows."""
    w, b = np.zeros(size), 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = (sigmoid(x.dot(w) + b) - y) * weight
        grad = np.append(np.bincount(x.slot, weights=x.value * g[x.row], minlength=size) + l2 * w / size, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, c of the calibrated log-odds a z + c, by Newton steps on smoothed targets; a is not negative."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = z.std() + 1e-9
    u, p = z / scale, np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(p[0] * u + p[1])
        g = np.array([((q - target) * u).sum(), (q - target).sum()]) + 1e-3 * p
        s = q * (1 - q)
        h = np.array([[(s * u * u).sum(), (s * u).sum()], [(s * u).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - np.clip(step, -2, 2)
    return max(0.0, p[0]) / scale, p[1]


@dataclass
class Model:
    """Weights of both views, their calibration, the prior log-odds and the cutoff."""

    content: tuple[np.ndarray, float]
    page: tuple[np.ndarray, float]
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float
    cutoff: float

    def combine(self, zc: np.ndarray, zp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, p = (a * z + b for (a, b), z in zip(self.scales, (zc, zp), strict=True))
        return sigmoid(c), sigmoid(p), sigmoid(c + p - self.prior)


class Featuriser:
    """Hashed words and shapes of many texts with their counts; each different piece of text is looked at once."""

    def __init__(self, size: int = 200_000):
        self.size, self.words, self.pieces = size, {}, {}

    def _piece(self, piece: str) -> bytes:
        out, known = b"", self.words
        for w in piece.split():
            if w not in known:
                a, s = word_slots(w)
                known[w] = np.array([a, WORDS + s], dtype=np.int32).tobytes()
            out += known[w]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slots, counts, bounds, words): each text's different slots in order with their counts, where each text's begin, and its number of words."""
        if len(self.words) + len(self.pieces) > self.size:
            self.words, self.pieces = {}, {}
        found, bounds = split_words(pc.fill_null(texts, ""))
        own = []
        for p in strings(found.dictionary):
            if p not in self.pieces:
                self.pieces[p] = self._piece(p)
            own.append(self.pieces[p])
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat, at = gather(np.frombuffer(b"".join(own), dtype=np.int32), sizes, np.asarray(found.indices))
        n = np.diff(at[bounds])
        width = WORDS + SHAPES
        keys, counts = np.unique(np.repeat(np.arange(len(n)), n) * width + flat, return_counts=True)
        return keys % width, counts, np.searchsorted(keys, np.arange(len(n) + 1) * width), n // 2


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), cell (of source and language), page, slots, counts and n_words for each row of ``docs``, written once."""
    names, types = ["doc_id", "h", "cell", "page", "slots", "counts", "n_words"], (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, pages = Featuriser(), {}
        for b in chunks(batches, 1, CHUNK // 4):  # sorting takes some ten times the chunk
            slots, counts, bounds, n = read(b.column(1))
            page = []
            for key in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if key not in pages:
                    if len(pages) > 100_000:
                        pages = {}
                    pages[key] = page_slots(*key)
                page.append(pages[key])
            lists = (pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (slots, counts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), b.column(6), pa.array(page, types[3]), *lists, pa.array(n, pa.int64())], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", F.col("n_chars").cast("long"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "cell": F.pmod(F.xxhash64("source", "lang"), F.lit(CELLS)).cast("int")})
    return materialize(rows.mapInArrow(run, "doc_id long, h long, cell int, page array<int>, slots array<int>, counts array<int>, n_words long"), "document-features")


def _sparse(slots: pa.ListArray, values: np.ndarray) -> Sparse:
    sizes = np.asarray(slots.value_lengths())
    return Sparse(np.asarray(slots.flatten()), values.astype(np.float32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes))


def _views(t: pa.Table | pa.RecordBatch) -> tuple[Sparse, Sparse]:
    """Both views of rows of ``featurise``."""
    one = lambda name: c.combine_chunks() if isinstance(c := t.column(name), pa.ChunkedArray) else c
    slots, page = one("slots"), one("page")
    at = np.asarray(slots.flatten())
    scale = np.where(at < WORDS, 1.0, SHAPE_SCALE) / np.repeat(np.maximum(np.asarray(t.column("n_words")), 1), np.asarray(slots.value_lengths()))
    return _sparse(slots, np.asarray(one("counts").flatten()) * scale), _sparse(page, np.ones(len(page.flatten())))


def _log_odds(t: pa.Table | pa.RecordBatch, models: list) -> list[np.ndarray]:
    return [x.dot(w) + b for x, (w, b) in zip(_views(t), models, strict=True)]


def _fetch(found: DataFrame, keys: DataFrame) -> pa.Table:
    """The features of ``keys`` (doc_id and h; different, and bounded by their maker), in order; of rows that repeat one, the least."""
    rest = F.struct("page", "slots", "counts", "n_words")
    table = found.join(F.broadcast(keys), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min(rest).alias("x")).select("doc_id", "h", "x.*").toArrow()
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("h", "ascending")]))


def _labelled(found: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The keys of the labelled rows to fit and the class of each doc_id; ``LABELLED`` at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("good"))
    some = materialize(known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(LABELLED), "labelled")
    keys = found.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("h").alias("h"))
    return materialize(keys, "labelled-keys"), {r.doc_id: r.good for r in some.collect()}


def _sure(found: DataFrame, fitted: DataFrame, models: list, quota: list[tuple[int, int]]) -> list[dict[tuple[int, int], int]]:
    """For each view the class of the rows (doc_id, h) that it is surest of among all that are not in ``fitted``; ``quota`` bounds the rows of both classes, and is shared among the strata."""
    sent = found.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for view, z in enumerate(_log_odds(b, sent.value)):
                p = sigmoid(z)
                at = np.flatnonzero((p <= 1 - SURE) | (p >= SURE))
                own = [b.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), view, np.int32)), pa.array((p[at] >= SURE).astype(np.int32)), pa.array(-np.abs(z[at]))], names=["doc_id", "h", "cell", "view", "good", "rank"])

    sure = found.where("doc_id is not null").mapInArrow(run, "doc_id long, h long, cell int, view int, good int, rank double")
    sure = sure.join(F.broadcast(fitted.select("doc_id")), "doc_id", "left_anti")  # LABELLED rows at most
    most = F.lit(0)
    for view, sizes in enumerate(quota):
        for good, n in enumerate(sizes):
            most = F.when((F.col("view") == view) & (F.col("good") == good), -(-n // CELLS)).otherwise(most)
    # Rows that repeat a document are one; the surest are cut inside the window, before its shuffle.
    sure = sure.groupBy("doc_id", "h", "view").agg(F.min(F.struct("rank", "cell", "good")).alias("x")).select("doc_id", "h", "view", "x.*")
    order = Window.partitionBy("view", "good", "cell").orderBy("rank", F.xxhash64("doc_id", "h"), "doc_id", "h")
    top = sure.withColumn("place", F.row_number().over(order)).where((F.col("place") <= max(1, -(-PSEUDO // CELLS))) & (F.col("place") <= most))
    out: list[dict] = [{}, {}]
    for r in top.select("doc_id", "h", "view", "good").collect():  # 2 views x 2 classes x CELLS x PSEUDO / CELLS rows at most
        out[r.view][(r.doc_id, r.h)] = r.good
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit by co-training; None where a class has too few rows."""
    return _train(featurise(docs), labels)


def _train(found: DataFrame, labels: DataFrame) -> Model | None:
    keys, good = _labelled(found, labels)
    table = _fetch(found, keys)
    ids = table["doc_id"].to_pylist()
    y = np.array([good[i] for i in ids], dtype=np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return None
    part = np.array([xxhash.xxh3_64_intdigest(str(i), 5) % 6 for i in ids])
    base, tuning, last = np.flatnonzero(part > 1), np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    if any(len(np.unique(y[at])) < 2 for at in (base, tuning, last)):
        return None
    prior = y[base].mean()
    extra: list[dict[tuple[int, int], int]] = [{}, {}]  # pseudo-labels that a view gets from the other
    for turn in range(ROUNDS + 1):
        models, more, whole = [], {}, table
        if any(extra):
            added = _fetch(found, found.sparkSession.createDataFrame(sorted({*extra[0], *extra[1]}), "doc_id long, h long"))
            more = {key: k for k, key in enumerate(zip(added["doc_id"].to_pylist(), added["h"].to_pylist(), strict=True))}
            whole = pa.concat_tables([table, added])
        views = tuple(zip(_views(whole), (WORDS + SHAPES, PAGE), strict=True))
        for (x, size), own in zip(views, extra, strict=True):
            lent = sorted(k for k in own if k in more)
            at = np.concatenate((base, np.array([len(table) + more[k] for k in lent], dtype=np.int64)))
            models.append(fit(x.pick(at), np.concatenate((y[base], np.array([own[k] for k in lent], dtype=np.int64))), size))
        if turn == ROUNDS:
            break
        n = PSEUDO * (turn + 1) / ROUNDS
        sizes = (int(n * (1 - prior)), int(n * prior))
        extra = _sure(found, keys, models, [sizes, sizes])[::-1]
    z = [x.dot(w) + b for (x, _), (w, b) in zip(views, models, strict=True)]
    out = Model(models[0], models[1], tuple(platt(v[tuning], y[tuning]) for v in z), float(np.log(prior / (1 - prior))), 0.5)
    best = np.sort(out.combine(*(v[last] for v in z))[2][y[last] == 1])
    out.cutoff = float(min(0.5, best[int(MAX_LOSS * len(best))]))
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content_score, page_score, score and kept for each row of ``docs``."""
    found = featurise(docs)
    return _scored(found, _train(found, labels))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``score`` with a model that is there."""
    return _scored(featurise(docs), model)


def _scored(found: DataFrame, model: Model | None) -> DataFrame:
    sent = found.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "content_score", "page_score", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            if m is None:
                half = pa.array(np.full(b.num_rows, 0.5))
                yield pa.RecordBatch.from_arrays([b.column(0), half, half, half, pa.array(np.ones(b.num_rows, bool))], names=names)
                continue
            a, q, both = m.combine(*_log_odds(b, [m.content, m.page]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a), pa.array(q), pa.array(both), pa.array(both >= m.cutoff)], names=names)

    return found.mapInArrow(run, "doc_id long, content_score double, page_score double, score double, kept boolean")
