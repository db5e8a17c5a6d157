"""Ranking notes for many queries at once: BM25, cosine, fusion."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.text import recency, strength
from notelake.operators.skew import join_counted
from notelake.sources.scratch import materialize

#: The published BM25 constants.
K1, B = 1.2, 0.75


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def terms(docs: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """key, term and tf: a row for each distinct term of a text; with ``only``, for the terms of that table, and the others are dropped before the shuffle where it is small."""
    rows = docs.select(key, F.explode(_words(text)).alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25_stats(tf: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document frequency by term, length by document, and one row of totals."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    length = tf.groupBy(key).agg(F.sum("tf").alias("dl"))
    return df, length, length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _postings(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, max_sent: int, *carry: str) -> tuple[DataFrame, DataFrame]:
    """(query and term; term, document, ``carry`` and the term's weight in the document), each for the terms that some query has.

    Counts and lengths are those of all documents. Where the queries have at
    most ``max_sent`` terms (counted) these and their document counts are sent
    to the tasks, so that a frequent term is no hot key.
    """
    asked = terms(queries, query_key).select(query_key, "term")
    sent = F.broadcast if asked.limit(max_sent + 1).count() <= max_sent else lambda df: df
    used = terms(docs, doc_key, only=sent(asked.select("term").distinct()))
    length = docs.select(doc_key, *carry, F.size(_words("text")).cast("long").alias("dl")).where("dl > 0").groupBy(doc_key).agg(F.sum("dl").alias("dl"), *(F.min(c).alias(c) for c in carry))
    total = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weigh = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = used.join(sent(df), "term").join(length, doc_key).join(F.broadcast(total)).select("term", doc_key, *carry, weigh.alias("w"))  # totals: one row
    return asked, weighed


#: Terms of queries that are sent to the tasks at once; terms of documents that a task scores at once.
ASKED, SCORED = 1 << 20, 1 << 19


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, k: int, within: str | None = None, only: str = "true", same: bool = False, max_sent: int = 200_000, block: int = ASKED, chunk: int = SCORED) -> DataFrame:
    """query, document, score and place of the k best documents of each query (in each value of ``within``), exactly.

    ``only`` says which documents may be found; all count in the statistics.
    With ``same`` queries are documents too, and none is an answer to itself.
    Keys are integers. The queries' terms go to the tasks in blocks of some
    ``block``; a task has whole documents, adds up the weights of each query's
    terms by document, some ``chunk`` terms of documents at a time, and keeps
    the k best of each query. So what is shuffled is each document's terms once
    a block and the best of each task, and no pair of a query and a document,
    however common their words.
    """
    group = [within] if within else []
    open_ = docs.withColumn("_open", F.coalesce(F.expr(only), F.lit(False)))
    asked, weighed = _postings(queries, open_, query_key, doc_key, max_sent, *group, "_open")
    asked, weighed = materialize(asked.where(F.col(query_key).isNotNull()), "bm25-asked"), materialize(weighed.where("_open").drop("_open"), "bm25-postings")
    of = F.col(within).cast("string") if within else F.lit("")
    rows = weighed.select(F.col(doc_key).cast("long").alias("doc"), of.alias("of"), "term", "w").repartition("doc").sortWithinPartitions("doc")
    blocks, found = max(1, -(-asked.count() // block)), None
    for b in range(blocks):
        part = _scored(rows, asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b), query_key, k, same, chunk)
        found = part if found is None else found.unionByName(part)
    kind = lambda df, key: F.col({doc_key: "doc", query_key: "query"}[key]).cast(df.schema[key].dataType).alias(key)
    carried = [F.col("of").cast(weighed.schema[within].dataType).alias(within)] if within else []
    found = found.select(kind(asked, query_key), *carried, kind(weighed, doc_key), "score")
    return best(materialize(found, "bm25-candidates"), query_key, doc_key, k, *group)


def _scored(rows: DataFrame, asked: DataFrame, query_key: str, k: int, same: bool, chunk: int) -> DataFrame:
    """query, of, doc and score: the k best documents that a task has for each query of ``asked``, one block; ``rows`` has doc, of, term and w, and a document's rows are in one partition, in order."""
    table = asked.select(F.col(query_key).cast("long").alias("query"), "term").orderBy("query", "term").toArrow()
    words = table["term"].combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    ids, first = np.unique(table["query"].to_numpy(), return_index=True)
    sent = rows.sparkSession.sparkContext.broadcast((ids, np.append(first, table.num_rows), words.dictionary, words.indices.to_numpy()))

    def add(tops: dict[str | None, _Top], held: list[pa.RecordBatch]) -> None:
        ids, bounds, terms, asks = sent.value
        t = pa.Table.from_batches(held).combine_chunks()
        names = t["of"].combine_chunks().dictionary_encode()
        of, term = names.indices.fill_null(-1).to_numpy(), pc.index_in(t["term"].combine_chunks(), value_set=terms).fill_null(-1).to_numpy()
        doc, w = t["doc"].to_numpy(), t["w"].to_numpy()
        for code in np.unique(of):
            use = np.flatnonzero((of == code) & (term >= 0))
            use = use[np.argsort(term[use], kind="stable")]  # each term's documents, end to end
            docs, row = np.unique(doc[use], return_inverse=True)
            weights, sizes = w[use], np.bincount(term[use], minlength=len(terms))
            starts = np.cumsum(sizes) - sizes
            top = tops.setdefault(names.dictionary[code].as_py() if code >= 0 else None, _Top(ids, None, k))
            for q in range(len(ids)):
                own = asks[bounds[q] : bounds[q + 1]]
                n = sizes[own]
                own, n = own[n > 0], n[n > 0]
                if len(own):
                    at = np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
                    scores = np.bincount(row[at], weights=weights[at], minlength=len(docs))
                    if same:
                        scores[docs == ids[q]] = 0.0
                    top.take(q, docs, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[str | None, _Top] = {}
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                # The last document goes on in the next batch, maybe.
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(np.searchsorted(whole.column(0).to_numpy(), whole.column(0)[n - 1].as_py()))
                if cut:
                    add(tops, [whole.slice(0, cut)])
                held = [whole.slice(cut)]
                n = held[0].num_rows
        if n:
            add(tops, held)
        for name, top in tops.items():
            query, doc, score = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array([name] * len(doc), pa.string()), pa.array(doc), pa.array(score)], names=["query", "of", "doc", "score"])

    return rows.mapInArrow(run, "query long, of string, doc long, score double")


def best(scored: DataFrame, query_key: str, doc_key: str, k: int, *within: str) -> DataFrame:
    """The k best rows of each query (and value of ``within``) with their place; cut inside the window, before its shuffle."""
    place = F.row_number().over(Window.partitionBy(query_key, *within).orderBy(F.desc("score"), doc_key))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Scores that a task computes at once.
SCORES = 1 << 21


class _Top:
    """The k best rows seen so far for each query; what a slice of rows adds waits until there is enough to sort."""

    def __init__(self, query_ids: np.ndarray, vectors: np.ndarray | None, k: int):
        self.query_ids, self.vectors, self.k = query_ids, vectors, k
        self.floor, self.waiting = np.full(len(query_ids), -np.inf), 0
        self.found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step, k = max(1, SCORES // max(1, len(self.query_ids))), self.k
        for lo in range(0, len(ids), step):
            own = ids[lo : lo + step]
            scores = np.round(vectors[lo : lo + step] @ self.vectors.T, 6)
            scores[own[:, None] == self.query_ids[None, :]] = -np.inf  # a row is no answer to itself
            least = np.maximum(self.floor, np.partition(scores, len(own) - k, axis=0)[len(own) - k]) if len(own) > k else self.floor
            row, query = np.nonzero((scores >= least) & (scores > -np.inf))  # ties with the last place may yet come before it
            self.found.append((query, scores[row, query], own[row]))
            if sum(len(x[0]) for x in self.found[1:]) > 4 * k * len(self.query_ids) + SCORES // 8:
                self._sort()

    def take(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """The scores of the q-th query; what is not above 0 is no hit."""
        scores = np.round(scores, 6)
        use = np.flatnonzero((scores >= self.floor[q]) & (scores > 0))
        if len(use) > self.k:
            use = use[scores[use] >= np.partition(scores[use], len(use) - self.k)[len(use) - self.k]]
        self.found.append((np.full(len(use), q), scores[use], ids[use]))
        self.waiting += len(use)
        if self.waiting > 4 * self.k * len(self.query_ids) + SCORES // 8 or len(self.found) > SCORES // 8:
            self._sort()

    def _sort(self) -> None:
        self.waiting = 0
        query, score, vec = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.floor[query[place == self.k - 1]] = score[place == self.k - 1]
        self.found = [(query[keep], score[keep], vec[keep])]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._sort()
        query, score, vec = self.found[0]
        return self.query_ids[query], vec, score


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, within: str | None = None, block: int = 1 << 20) -> DataFrame:
    """query_id, vec_id, score and place of the k rows of ``corpus`` nearest to each query (in each value of the column ``within``, a text).

    Queries go to the tasks in blocks of ``block`` numbers, and each task keeps
    the k best of every query before anything is shuffled. A row is no answer
    to itself; rows whose vec_id or vector is null, or whose vector is of
    another length than the queries' first, are left out; ties go to the lower
    vec_id. A task holds ``SCORES`` scores, one block and the best so far.
    """
    spark = queries.sparkSession
    q = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    head = q.select(F.size("q").alias("n")).first()
    width = head.n if head else 1
    q = q.where(F.size("q") == width)
    blocks = max(1, -(-q.count() * width // block))
    of = F.col(within) if within else F.lit("")
    rows = corpus.where((F.size("embedding") == width) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), of.cast("string").alias("of"), F.col("embedding").cast("array<double>"))
    parts = []
    for b in range(blocks):
        table = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # one block
        ids = table["query_id"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, np.asarray(table["q"].combine_chunks().flatten()).reshape(len(ids), width)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tops: dict[str | None, _Top] = {}
            for x in batches:
                names = np.array(x.column(1).to_pylist(), dtype=object)
                vectors = np.asarray(x.column(2).flatten()).reshape(-1, width)
                for name in set(names.tolist()):
                    own = names == name
                    tops.setdefault(name, _Top(*sent.value, k)).add(x.column(0).to_numpy()[own], vectors[own])
            for name, top in tops.items():
                query, vec, score = top.rows()
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array([name] * len(vec), pa.string()), pa.array(score)], names=["query_id", "vec_id", "of", "score"])

        found = rows.mapInArrow(run, "query_id long, vec_id long, of string, score double")
        parts.append(found if blocks == 1 else materialize(best(found, "query_id", "vec_id", k, "of").drop("place"), "nearest"))
    scored = parts[0]
    for more in parts[1:]:
        scored = scored.unionByName(more)
    out = best(scored, "query_id", "vec_id", k, "of")
    return out.withColumnRenamed("of", within) if within else out.drop("of")


def nearest_within(queries: DataFrame, corpus: DataFrame, group: str, k: int, least: float = -2.0, per: bool = False, block: int = 2_000) -> DataFrame:
    """query_id, vec_id and score of the ``k`` rows of ``corpus`` nearest to each query among those of its group, at ``least`` or above.

    A query may ask in several groups, and with ``per`` gets k rows of each.
    Both sides have vec_id, ``group`` and embedding. A group's rows are dealt
    into parts of some ``block`` on each side, and a task compares one part of
    the queries with one of the corpus and keeps the k best, so a group with
    most rows is the work of many tasks. A row is no answer to itself; null
    ids, groups and vectors are left out; vectors of another length are of
    another group; ties go to the lower vec_id.
    """

    def dealt(df: DataFrame, side: int) -> DataFrame:
        of = F.concat_ws(":", F.size("embedding").cast("string"), F.col(group).cast("string"))
        return df.where(f"vec_id is not null and `{group}` is not null and embedding is not null").select(F.lit(side).alias("side"), F.col("vec_id").cast("long").alias("id"), of.alias("of"), F.col("embedding").cast("array<double>").alias("v"))

    sides = [dealt(queries, 0), dealt(corpus, 1)]
    sizes = sides[0].unionByName(sides[1]).groupBy("of").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), F.count("*").alias("n"))
    parts = []
    for side, df in enumerate(sides):
        df = join_counted(df, sizes.where("n0 > 0 and n1 > 0"), "of", "n").where("n is not null")
        mine, other = (F.ceil(F.col(f"n{s}") / block).cast("int") for s in (side, 1 - side))
        df = df.withColumns({"mine": F.pmod(F.xxhash64("id", F.lit(side)), mine).cast("int"), "other": F.explode(F.sequence(F.lit(0), other - 1))})
        at = ("mine", "other") if side == 0 else ("other", "mine")
        parts.append(df.select("side", "id", "of", "v", F.col(at[0]).alias("p"), F.col(at[1]).alias("q")))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        vectors = np.asarray(t["v"].combine_chunks().flatten()).reshape(len(ids), -1)
        top = _Top(ids[side == 0], vectors[side == 0], k)
        top.add(ids[side == 1], vectors[side == 1])
        query, vec, score = top.rows()
        use = score >= least
        return pa.table({"query_id": query[use], "of": pa.array([t["of"][0].as_py()] * use.sum(), pa.string()), "vec_id": vec[use], "score": score[use]})

    found = parts[0].unionByName(parts[1]).groupBy("of", "p", "q").applyInArrow(compare, "query_id long, of string, vec_id long, score double")
    return best(found, "query_id", "vec_id", k, *(["of"] if per else [])).drop("of")


def fuse(signals: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row for each id with every signal's best score, null where a signal missed it; ``signals`` have the keys and score."""
    rows = None
    for name, hits in signals.items():
        own = hits.select(*keys, *((F.col("score") if s == name else F.lit(None).cast("double")).alias(s) for s in signals))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*keys).agg(*(F.max(s).alias(s) for s in signals))


#: How much each signal counts in a search over all of them; a search by one signal takes it whole.
WEIGHTS = {"semantic": 0.75, "keyword": 0.25, "image": 0.4}
FLOOR = 0.05


def hybrid_score(signals: dict[str, Column], superseded: Column, age_days: Column, mode: str = "hybrid") -> Column:
    """The weighted strengths (four places each), halved for superseded notes, with the boost for recent ones."""
    total = F.lit(0.0)
    for name, score in signals.items():
        total = total + (WEIGHTS[name] if mode == "hybrid" else 1.0) * F.coalesce(F.round(strength(score, name), 4), F.lit(0.0))
    return total * F.when(superseded, 0.5).otherwise(1.0) * recency(age_days)


def featurise(docs: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Hashed word counts, scaled to unit length, as (key, bucket, weight); a model's vectors can take their place as a column."""
    tf = terms(docs, key).withColumn("bucket", F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int") % buckets)
    hashed = tf.groupBy(key, "bucket").agg(F.sum("tf").alias("n"))
    size = hashed.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return hashed.join(size, key).select(key, "bucket", F.round(F.col("n") / F.col("size"), 6).alias("weight"))
