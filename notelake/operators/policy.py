"""Category, scope and learned choices for notes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.spans import kinds_of, mask_spans
from notelake.functions.text import CATEGORY_WORDS, SCOPE_WORDS, in_words
from notelake.operators.retrieval import dot, nearest_within
from notelake.sources.scratch import materialize

NEAR = 0.03
# The categories with their default scope and priority.
CATEGORIES = {
    "safety_hazard": ("shared", 2), "equipment_fault": ("shared", 1), "procedure_fix": ("shared", 1), "routine_reading": ("shared", 0),
    "personal_health": ("private", 0), "people_hr": ("private", 0), "scratch_note": ("private", 0),
}
# The sentences that explain a decision.
REASONS = {
    "credential": "Contains a credential, which is never uploaded.",
    "private": 'Reads as "{}", which stays on this device.',
    "also": "Also contains personal details: {}.",
    "useful": 'Reads as "{}", which is useful to other devices.',
    "masked": "Personal details ({}) are masked in the cloud copy; the original stays here.",
    "plain": 'Reads as "{}" with no personal details, so it is shared.',
    "partly private": 'Also reads partly as "{}". Check it before it is shared.',
    "partly shared": 'Also reads partly as "{}", which the fleet may need. Share it by hand if the personal part can go.',
    "urgent": "Safety related, so it is sent first when the link returns.",
    "refused": "Sharing was requested, but a credential is present, so it stays private.",
    "user": "Set to {} by the user.",
    "user masked": "Personal details are still masked in the cloud copy.",
}
LEARNED_REASON = "A note like this one ({}% similar) was set to {} by hand before, so this one follows it."
#: Labels whose prototypes are sent to every task at once.
MAX_LABELS = 2_000


def prototypes(vectors: DataFrame, per_label: int = 5, max_labels: int = MAX_LABELS) -> DataFrame:
    """The first vectors of each label, in blocks of some ``max_labels`` labels: block and an array of (label, vectors)."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = vectors.where("label is not null and embedding is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label)
    own = F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").alias("v"))))  # per_label vectors at most
    per = materialize(rows.groupBy("label").agg(F.transform(own, lambda x: x["v"]).alias("vs")), "label-prototypes")
    blocks = max(1, -(-per.count() // max_labels))
    per = per.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int"))
    return materialize(per.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("label", "vs"))).alias("protos")), "prototypes")


def category_scores(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """vec_id and scores, an array of (score, label): 0.7 of the best and 0.3 of the mean cosine with a label's prototypes.

    One block of ``protos`` is sent to the tasks at a time; with several, the
    scores of a vec_id (which is unique) are put together again.
    """

    def score(p: Column) -> Column:
        cos = F.transform(p["vs"], lambda v: dot(F.col("embedding"), v))
        mean = F.aggregate(cos, F.lit(0.0), lambda a, x: a + x) / F.size(cos)
        return F.struct(F.round(0.7 * F.array_max(cos) + 0.3 * mean, 6).alias("score"), p["label"].alias("label"))

    parts = []
    for r in protos.select("block").collect():  # labels / max_labels rows
        one = protos.where(F.col("block") == r.block).select("protos")
        parts.append(vectors.select("vec_id", "embedding").join(F.broadcast(one)).select("vec_id", F.transform("protos", score).alias("scores")))  # one row
    if not parts:
        return vectors.select("vec_id", F.array().cast("array<struct<score:double,label:int>>").alias("scores"))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("vec_id").agg(F.flatten(F.collect_list("scores")).alias("scores"))  # a number for each label


def classify(scored: DataFrame) -> DataFrame:
    """Best label, confidence from the margin to the second, and the labels near the best."""
    order = F.reverse(F.array_sort(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["label"]).alias("label")))))
    df = scored.withColumn("o", order)
    best, second = F.col("o")[0]["score"], F.col("o")[1]["score"]
    near = F.transform(F.filter("o", lambda s: s["score"] >= best - NEAR), lambda s: -s["label"])
    return df.select("vec_id", (-F.col("o")[0]["label"]).alias("label"), best.alias("score"), F.round(F.least(F.lit(0.99), 0.5 + 4 * (best - second)), 2).alias("confidence"), F.array_join(near, ",").alias("near"))


def _by_category(category: Column, place: int) -> Column:
    return in_words(category, {c: v[place] for c, v in CATEGORIES.items()})


def override(scope: Column, choice: Column, credential: Column, signals: Column) -> Column:
    """A person's choice in place of the decision; a credential cannot be widened, and what is shared with signals is redacted."""
    return F.when(choice.isNull() | credential, scope).when((choice == "shared") & signals, "redacted").otherwise(choice)


def decide(notes: DataFrame) -> DataFrame:
    """``notes`` with scope, priority, review, decided_by, reasons and shared_text.

    ``notes`` has text, spans, categories (best first), learned (a struct of
    scope and cosine, or null) and choice (a scope, or null). A credential
    keeps a note private whatever else is said; a private category keeps it on
    the device; any other signal has it masked. A choice once made for a note
    like it comes next, and the person's own choice last; both may widen a
    private note, whose details are then masked.
    """
    kinds = kinds_of(F.col("spans"))
    n = notes.withColumns({"_kinds": kinds, "_category": F.get("categories", F.lit(0))})
    n = n.withColumns({"_secret": F.array_contains("_kinds", "credential"), "_signals": F.size("spans") > 0, "_default": _by_category(F.col("_category"), 0), "_priority": _by_category(F.col("_category"), 1)})
    secret, signals, default, listed = F.col("_secret"), F.col("_signals"), F.col("_default"), F.array_join("_kinds", ", ")
    scope = F.when(secret | (default == "private"), "private").when(signals, "redacted").otherwise("shared")
    other = F.get(F.filter("categories", lambda c: _by_category(c, 0) != F.col("_default")), F.lit(0))
    mixed = ~secret & other.isNotNull()

    def say(name: str, *words: Column) -> Column:
        return F.format_string(REASONS[name].replace("%", "%%").replace("{}", "%s"), *words)

    label, other_label = in_words(F.col("_category"), CATEGORY_WORDS), in_words(other, CATEGORY_WORDS)
    kept = ~secret & (default == "private")
    reasons = F.array(
        F.when(secret, say("credential")).when(kept, say("private", label)).when(signals, say("useful", label)).otherwise(say("plain", label)),
        F.when(kept & signals, say("also", listed)).when(~secret & ~kept & signals, say("masked", listed)),
        F.when(mixed, F.when(_by_category(other, 0) == "private", say("partly private", other_label)).otherwise(say("partly shared", other_label))),
        F.when((scope != "private") & (F.col("_priority") == 2), say("urgent")),
    )
    n = n.withColumn("_0", F.struct(scope.alias("scope"), F.when(secret, 0).otherwise(F.col("_priority")).alias("priority"), mixed.alias("review"), F.lit("policy").alias("by"), F.array_compact(reasons).alias("reasons")))

    def apply(was: Column, choice: Column, by: str, reasons: Column) -> Column:
        to = F.when((choice == "shared") & signals, "redacted").otherwise(choice)
        priority = F.when(to == "private", 0).otherwise(F.col("_priority"))
        return F.struct(to.alias("scope"), priority.alias("priority"), F.lit(False).alias("review"), F.lit(by).alias("by"), reasons.alias("reasons"))

    recalled, chosen = F.col("learned.scope"), F.col("choice")
    known = lambda c: c.isin("private", "shared", "redacted")
    learned_to = F.when((recalled == "shared") & signals, "redacted").otherwise(recalled)
    like = F.format_string(LEARNED_REASON.replace("%", "%%").replace("{}", "%s"), F.floor(F.col("learned.cosine") * 100), in_words(learned_to, SCOPE_WORDS))
    n = n.withColumn("_1", F.when(known(recalled) & ~secret & (recalled != F.col("_0.scope")), apply(F.col("_0"), recalled, "learned", F.array(like))).otherwise(F.col("_0")))
    was, user_to = F.col("_1"), F.when((chosen == "shared") & signals, "redacted").otherwise(chosen)
    told = F.array_compact(F.array(say("user", user_to), F.when(user_to == "redacted", say("user masked"))))
    refused = F.struct(was["scope"].alias("scope"), was["priority"].alias("priority"), was["review"].alias("review"), was["by"].alias("by"), F.array_append(was["reasons"], F.lit(REASONS["refused"])).alias("reasons"))
    done = F.when(~F.coalesce(known(chosen), F.lit(False)) | (chosen == was["scope"]), was).when((chosen != "private") & secret, refused).otherwise(apply(was, chosen, "user", told))
    n = n.withColumn("_2", done)
    fields = {"scope": F.col("_2.scope"), "priority": F.col("_2.priority"), "review": F.col("_2.review"), "decided_by": F.col("_2.by"), "reasons": F.col("_2.reasons")}
    shared = F.when(F.col("_2.scope") == "redacted", mask_spans(F.col("text"), F.col("spans")))
    return n.withColumns(fields | {"shared_text": shared}).drop("_kinds", "_category", "_secret", "_signals", "_default", "_priority", "_0", "_1", "_2")


def nearest_example(vectors: DataFrame, examples: DataFrame, least: float, same: str) -> DataFrame:
    """vec_id, example and cosine: for each vector the nearest example of its group at or above ``least``."""
    near = nearest_within(vectors, examples, same, 1, least)
    return near.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("example"), F.col("score").alias("cosine"))
