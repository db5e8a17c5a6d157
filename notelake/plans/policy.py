"""Classification, decisions, overrides, learned examples and related notes."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions import text as x
from notelake.functions.spans import kinds_of, mask_spans, with_spans
from notelake.operators import policy as p
from notelake.operators import retrieval as r
from notelake.plans.registry import query

_DOT = "list_inner_product({a}.embedding::double[], {b}.embedding::double[])"
_PROTO = "pr as (select label as pl, embedding from (select *, row_number() over (partition by label order by vec_id) as n from embeddings) where n <= 5)"
_SC = f"{_PROTO}, sc as (select e.vec_id, pl as label, round(0.7 * max({_DOT.format(a='e', b='pr')}) + 0.3 * avg({_DOT.format(a='e', b='pr')}), 6) as score from embeddings e, pr group by e.vec_id, pl)"


def _scores(t):
    return p.category_scores(t.embeddings, p.prototypes(t.embeddings))


@query(f"with {_SC} select vec_id, label, score from sc")
def prototype_scores(t):
    return _scores(t).select("vec_id", F.explode("scores").alias("s")).select("vec_id", "s.label", "s.score")


@query(f"with {_SC} select vec_id, max(score) as best, round(avg(score), 9) as mean from sc group by vec_id", name="category_score")
def category_score(t):
    each = F.transform("scores", lambda s: s["score"])
    return _scores(t).select("vec_id", F.array_max(each).alias("best"), F.round(F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / F.size(each), 9).alias("mean"))


_RANK = f"{_SC}, rk as (select *, row_number() over (partition by vec_id order by score desc, label) as n, max(score) over (partition by vec_id) as best from sc)"
_CLASS = f"""{_RANK}, cl as (select vec_id, max(label) filter (where n = 1) as label, max(best) as score, round(least(0.99, 0.5 + 4 * (max(best) - max(score) filter (where n = 2))), 2) as confidence, string_agg(label::varchar, ',' order by n) filter (where score >= best - 0.03) as near from rk group by vec_id)"""


@query(f"with {_CLASS} select * from cl")
def classify_notes(t):
    return p.classify(_scores(t))


@query(f"with {_RANK} select vec_id, string_agg(label::varchar, ',' order by n) as near from rk where score >= best - 0.03 group by vec_id")
def near_best(t):
    return p.classify(_scores(t)).select("vec_id", "near")


@query(f"with {_CLASS} select vec_id, confidence from cl")
def confidence(t):
    return p.classify(_scores(t)).select("vec_id", "confidence")


_NAMES = list(p.CATEGORIES)
_SCOPE_OF = "[" + ", ".join(f"'{scope}'" for scope, _ in p.CATEGORIES.values()) + f"][y::int % {len(_NAMES)} + 1]"


def _categories(near):
    """The categories of the labels near the best, best first; a label stands for one by its number."""
    return F.array_distinct(F.transform(F.split(near, ","), lambda y: F.get(F.array(*map(F.lit, _NAMES)), y.cast("int") % len(_NAMES))))


@query(f"with {_CLASS} select vec_id, len(list_distinct(list_transform(string_split(near, ','), lambda y: {_SCOPE_OF}))) > 1 as mixed from cl")
def mixed_flag(t):
    scopes = F.array_distinct(F.transform(_categories(F.col("near")), lambda c: x.in_words(c, {k: v[0] for k, v in p.CATEGORIES.items()})))
    return p.classify(_scores(t)).select("vec_id", (F.size(scopes) > 1).alias("mixed"))


def decided(t, choice=None):
    """The decision on every document that has a vector: its category from the vector, its signals from the text, the choice learned for the nearest known note.

    Texts are looked into after the joins, so the detector goes through none that has no vector.
    """
    near = p.classify(_scores(t)).select(F.col("vec_id").alias("doc_id"), _categories(F.col("near")).alias("categories"), "confidence")
    new, known = _halves(t)
    scope = F.when(F.col("example") % 3 == 0, "private").when(F.col("example") % 3 == 1, "shared").otherwise("redacted")
    learned = p.nearest_example(new, known, 0.4, "label").select(F.col("vec_id").alias("doc_id"), F.struct(scope.alias("scope"), "cosine").alias("learned"))
    notes = with_spans(t.documents.select("doc_id", "text").join(near, "doc_id").join(learned, "doc_id", "left"))
    return p.decide(notes.withColumn("choice", F.lit(None).cast("string") if choice is None else choice))


def _shown():
    return ["doc_id", F.col("categories")[0].alias("category"), "confidence", "scope", "priority", "review", "decided_by", F.array_join("reasons", " ").alias("reasons")]


@query()
def decide_scope(t):
    return decided(t).select(*_shown(), F.md5("shared_text").alias("shared_md5"))


@query()
def apply_override(t):
    """A person's choice for a half of the notes."""
    choice = F.when(F.col("doc_id") % 4 == 0, "shared").when(F.col("doc_id") % 4 == 1, "private")
    return decided(t, choice).select(*_shown())


def _halves(t):
    return t.embeddings.where("vec_id % 2 = 1"), t.embeddings.where("vec_id % 2 = 0")


_NEAREST = f"nn as (select vec_id, first(example order by c desc, example) as example, max(c) as cosine from (select a.vec_id, b.vec_id as example, round({_DOT.format(a='a', b='b')}, 6) as c from embeddings a join embeddings b on a.label = b.label where a.vec_id % 2 = 1 and b.vec_id % 2 = 0) where c >= {{least}} group by vec_id)"


@query(f"with {_NEAREST.format(least=0.2)} select * from nn")
def recall_override(t):
    """The bound is a parameter: these vectors lie further apart than a text model's."""
    new, known = _halves(t)
    return p.nearest_example(new, known, 0.2, "label")


@query(f"with {_NEAREST.format(least=0.3)}, all_ as (select coalesce(nn.example, e.vec_id) as example, e.vec_id as learned_at from embeddings e left join nn using (vec_id) where e.vec_id % 2 = 1 union all select vec_id, vec_id from embeddings where vec_id % 2 = 0) select example, learned_at from (select example, max(learned_at) as learned_at from all_ group by example) order by learned_at desc, example limit 200")
def learn_override(t):
    """A near example is updated, another is added; the newest 200 stay (the feature)."""
    new, known = _halves(t)
    hit = p.nearest_example(new, known, 0.3, "label").select("vec_id", "example")
    rows = new.join(hit, "vec_id", "left").select(F.coalesce("example", "vec_id").alias("example"), F.col("vec_id").alias("learned_at")).unionByName(known.select(F.col("vec_id").alias("example"), F.col("vec_id").alias("learned_at")))
    return rows.groupBy("example").agg(F.max("learned_at").alias("learned_at")).orderBy(F.desc("learned_at"), "example").limit(200)


@query(f"with {_NEAREST.format(least=0.2)} select vec_id, case when vec_id % 10 = 1 then 'private' when nn.example is not null then case nn.example % 3 when 0 then 'private' when 1 then 'shared' else 'redacted' end else 'shared' end as scope from embeddings e left join nn using (vec_id) where e.vec_id % 2 = 1")
def follow_learned(t):
    new, known = _halves(t)
    learned = F.when(F.col("example") % 3 == 0, "private").when(F.col("example") % 3 == 1, "shared").otherwise("redacted")
    df = new.select("vec_id").join(p.nearest_example(new, known, 0.2, "label"), "vec_id", "left")
    return df.select("vec_id", F.when(F.col("vec_id") % 10 == 1, "private").when(F.col("example").isNotNull(), learned).otherwise("shared").alias("scope"))


@query("select example, learned_at from (select vec_id as example, vec_id as learned_at from embeddings where vec_id % 3 = 0 union select vec_id, vec_id from embeddings where vec_id % 2 = 0) order by learned_at desc limit 200")
def merge_examples(t):
    old = t.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("example"))
    new = t.embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").alias("example")).join(old, "example", "left_anti")
    return old.unionByName(new).select("example", F.col("example").alias("learned_at")).orderBy(F.desc("learned_at")).limit(200)


# The similarities of a rewording, a follow-up and a related note by a text model; the vectors of the given tables lie further apart, so the query has its own.
BANDS = {"duplicate": 0.97, "updates": 0.80, "related": 0.60}
_BANDS = {"duplicate": 0.5, "updates": 0.4, "related": 0.2}
_RESOLVED = r"\b(" + "|".join(x.RESOLVED) + r")\b"
_RELATED = f"""
with m as (select vec_id, embedding, asset, status, kind, shard, n.text from embeddings e join notes n on n.memory_id = e.vec_id where asset is not null),
s as (select a.vec_id, b.vec_id as other, b.shard, b.kind, a.text, round({_DOT.format(a='a', b='b')}, 6) as cosine from m a join m b on a.asset = b.asset and a.vec_id <> b.vec_id and b.status = 'active' where a.vec_id % 50 = 0),
k as (select *, row_number() over (partition by vec_id, shard order by cosine desc, other) as n from s),
o as (select *, row_number() over (partition by vec_id order by cosine desc, other) as place from k where n <= 3 and cosine >= {_BANDS['related']})
select vec_id, other, cosine, case when kind = 'reference' then 'related' when cosine >= {_BANDS['duplicate']} then 'duplicate' when cosine >= {_BANDS['updates']} then case when regexp_matches(lower(text), '{_RESOLVED}') then 'resolves' else 'updates' end else 'related' end as relation from o where place <= 3"""


def related(queries, notes, bands=BANDS, limit=3):
    """Of the active notes on the same asset in each shard the ``limit`` most alike, and of all these above the lowest band again: vec_id, other, cosine, relation.

    An asset and shard is a group; a query looks into every shard that there is.
    """
    active = notes.where("status = 'active' and asset is not null and shard is not null")
    shards = F.array(*map(F.lit, ("local", "replica")))
    place = lambda shard: F.concat_ws(":", shard, F.col("asset"))
    asked = queries.where("asset is not null").select("vec_id", "asset", "embedding", F.explode(shards).alias("in")).select("vec_id", place(F.col("in")).alias("place"), "embedding")
    near = r.nearest_within(asked, active.select("vec_id", place(F.col("shard")).alias("place"), "embedding"), "place", limit, bands["related"], per=True)
    order = [F.desc("cosine"), "other"]
    top = near.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("other"), F.col("score").alias("cosine"))
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy(*order))).where(F.col("n") <= limit)
    top = top.join(queries.select("vec_id", "text"), "vec_id").join(active.select(F.col("vec_id").alias("other"), "kind"), "other")
    follow = F.when(x.says_resolved(F.col("text")), "resolves").otherwise("updates")
    relation = F.when(F.col("kind") == "reference", "related").when(F.col("cosine") >= bands["duplicate"], "duplicate").when(F.col("cosine") >= bands["updates"], follow).otherwise("related")
    return top.select("vec_id", "other", "cosine", relation.alias("relation"))


@query(_RELATED)
def related_notes(t):
    """Queries are the notes whose id is divisible by 50, against all notes."""
    m = t.embeddings.join(t.notes.where("asset is not null").select("memory_id", "asset", "status", "kind", "shard", "text"), F.col("vec_id") == F.col("memory_id"))
    return related(m.where("vec_id % 50 = 0"), m, _BANDS)


@query()
def preview(t):
    """Decision, related notes and masked text for each note; nothing is written."""
    alike = related_notes(t).groupBy(F.col("vec_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), lambda v: v["other"]), ",").alias("related"))
    shown = decided(t).select(*_shown(), F.array_join(kinds_of(F.col("spans")), ",").alias("signals"), F.md5("shared_text").alias("shared_md5"))
    return shown.join(alike, "doc_id", "left")


@query()
def masked_vector(t):
    """Features of the masked text, so that a vector tells no more than what is shared."""
    masked = with_spans(t.documents.select("doc_id", "text")).where("size(spans) > 0").select("doc_id", mask_spans(F.col("text"), F.col("spans")).alias("text"))
    return r.featurise(masked, "doc_id")
