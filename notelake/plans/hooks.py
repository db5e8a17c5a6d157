"""Queries through the places where a user's own model, scorer, store or migration enters."""

from pyspark.sql import functions as F

from notelake.functions import spans
from notelake.operators import hooks as h
from notelake.operators import retrieval as r
from notelake.plans.registry import query
from notelake.plans.retrieval import _BM, _W
from notelake.sources import versions
from notelake.sources.scratch import scratch_path


def _counts(texts):
    """A stand-in for a model: characters and words."""
    return [[float(len(t)), float(len(t.split(" ")))] for t in texts]


@query("select item_id, length(text)::double as chars, len(string_split(text, ' '))::double as words from benchmark")
def embed(t):
    return h.embed(t.benchmark, "item_id", _counts).select("item_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("words"))


_HEAD = 3


@query(f"""with {_BM}, five as (select *, row_number() over (partition by item_id order by score desc, doc_id) as was from sc qualify was <= 5),
b as (select item_id, doc_id, was, case when was <= {_HEAD} then round(0.4 * score + 0.6 * len(list_intersect(list_distinct({_W('b.text')}), list_distinct({_W('d.text')})))::double / len(list_distinct({_W('b.text')})), 4) else score end as score
  from five join benchmark b using (item_id) join documents d using (doc_id))
select item_id, doc_id, score, row_number() over (partition by item_id order by was > {_HEAD}, case when was <= {_HEAD} then -score end, was) as place from b""")
def rerank(t):
    """The first results of a keyword search, read again by a scorer."""
    found = r.bm25(t.benchmark, t.documents, "item_id", "doc_id", 5).join(t.benchmark.select("item_id", F.col("text").alias("query")), "item_id").join(t.documents.select("doc_id", "text"), "doc_id")
    rows = found.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("memory_id"), "query", "text", "score")
    return h.rerank(rows, h.shared_words, head=_HEAD).select(F.col("query_id").alias("item_id"), F.col("memory_id").alias("doc_id"), "score", "place")


@query("select memory_id, case when version = 0 then upper(kind) else kind end as kind, 1 as version from (select *, coalesce(try_cast(schema_text as int), 0) as version from notes) where version <= 1")
def migrate(t):
    """Notes of version 0 go through the one step there is; newer ones are held back."""
    notes = t.notes.select("memory_id", "kind", F.coalesce(F.col("schema_text").try_cast("int"), F.lit(0)).alias("version"))
    return h.migrate(notes, [lambda d: d.withColumn("kind", F.upper("kind"))])


@query("select vec_id as example, label, vec_id % 2 = 0 as newer from embeddings where (vec_id % 3 = 0 or vec_id % 2 = 0) and vec_id % 10 <> 0")
def example_store(t):
    """Learned examples in a versioned table: a first set, then a second that replaces and adds, less what is forgotten."""
    root = scratch_path(t.spark, "examples")
    rows = t.embeddings.select(F.col("vec_id").alias("example"), "label")
    versions.upsert(t.spark, root, rows.where("example % 3 = 0").withColumn("newer", F.lit(False)), ["example"])
    versions.upsert(t.spark, root, rows.where("example % 2 = 0").withColumn("newer", F.lit(True)), ["example"], rows.where("example % 10 = 0").select("example"))
    return versions.read(t.spark, root)


@query()
def add_names(t):
    """Detected spans with a name model's as persons; the model is one that takes the first ``stupid`` or ``Licensed`` of a text for a name."""
    raw = t.documents.select("doc_id", "text", spans.raw_spans("text").alias("raw"))
    at = lambda w: F.instr("text", w) - 1
    names = F.filter(F.array(*(F.struct(at(w).alias("start"), (at(w) + len(w)).alias("end")) for w in ("stupid", "Licensed"))), lambda n: n["start"] >= 0)
    found = raw.select("doc_id", h.add_names(F.col("raw"), names).alias("spans")).where("size(spans) > 0")
    return found.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*")
