"""License notices by diagonal voting.

All rolling three-word windows of a text are hash-joined to the template
positions (sent to the tasks where they are few, which is counted). A hit at
word p of template word q votes for the diagonal p - q, which is where the
template would start. Votes are aggregated by diagonal inside the task that
read the text, so what is shuffled is a row for each document and each diagonal
with a hit; a template of any length is held in masks of ``BITS`` positions.
Neighbouring diagonals of one template, which a few added or missing words set
apart, are merged, and a span is accepted when its distinct template windows
cover enough of the template and its diagonals lie no further apart than
``DRIFT`` of the template's length, so that its windows stand in the
template's order but for that many words; a diagonal that covers enough by
itself is accepted whatever lies beside it. The join compares hash and words,
so a span is verified word for word.

Defined results: a null text is empty; a text of fewer than three words has no
window; labels and scores of a document without hits are '' and 0; rows that
repeat a doc_id are scanned one by one; an empty table gives no rows; only
doc_id and text are read. A template of fewer than three words, or a null one,
matches nothing; equal templates count once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.sources.scratch import materialize

# The base phrases (all of whose places are reported) and the notices that add labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NOTICES = (
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
K = 3
#: Words by which diagonals of one occurrence may differ.
NEIGHBOUR = 3
#: Share of a notice's windows that a span must have, and by which its diagonals may differ.
COVER, DRIFT = 0.6, 0.25
#: Template positions in a mask, and positions that may be sent to every task.
BITS, MAX_SENT = 63, 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates(base=BASE, notices=NOTICES) -> list[tuple[str, str, bool]]:
    """(label, text, is_base) of the built-in templates."""
    return [(label, text, True) for label, text in base] + [(label, text, False) for label, text in notices]


def template_table(found: DataFrame) -> DataFrame:
    """A row for each window of the templates in ``found`` (label, text, is_base): hash, tid, label, is_base, windows, q, gram."""
    words = _words(F.col("text"))
    t = found.where("text is not null and label is not null").select(F.xxhash64("label", "text", "is_base").alias("tid"), "label", "is_base", words.alias("words")).dropDuplicates(["tid"])
    t = t.where(F.size("words") >= K).withColumn("grams", _grams(F.col("words")))
    t = t.select("tid", "label", "is_base", F.size("grams").alias("windows"), F.posexplode("grams").alias("q", "gram"))
    return t.select(F.xxhash64("gram").alias("hash"), "*")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x00-/:-`{-\\x7F]+"), "")


def _grams(w: Column) -> Column:
    return F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(K)))))


def diagonals(docs: DataFrame, table: DataFrame, max_sent: int = MAX_SENT) -> DataFrame:
    """rid, doc_id, n_words, tid, label, is_base, windows, diagonal, chunk and mask: a row for each diagonal (and chunk of template positions) with votes, one with null tid for the rest of each document."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", _words(F.col("text")).alias("words"))
    d = d.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), _grams(F.col("words")).alias("grams"))
    g = d.select("rid", "doc_id", "n_words", F.posexplode_outer("grams").alias("p", "gram")).withColumn("hash", F.xxhash64("gram"))
    hits = g.join(F.broadcast(table) if table.count() <= max_sent else table, ["hash", "gram"], "left")
    keys = ["rid", "doc_id", "n_words", "tid", "label", "is_base", "windows", (F.col("p") - F.col("q")).cast("long").alias("diagonal"), F.floor(F.col("q") / BITS).alias("chunk")]
    return hits.groupBy(*keys).agg(F.bit_or(F.expr(f"shiftleft(1L, q % {BITS})")).alias("mask"))


def spans(votes: DataFrame, cover: float = COVER) -> DataFrame:
    """``votes`` with span (of neighbouring diagonals) merged: first, last (diagonals), score, best (score of its best diagonal) and accepted for each span."""
    order = Window.partitionBy("rid", "tid").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR, F.lit(True))
    own = F.sum(F.bit_count("mask")).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    numbered = votes.withColumns({"fresh": fresh, "own": own}).withColumn("span", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    full = F.col("is_base") & (F.col("own") == F.col("windows")) & (F.col("chunk") == 0)
    keys = ["rid", "doc_id", "n_words", "tid", "label", "is_base", "windows", "span"]
    chunks = numbered.groupBy(*keys, "chunk").agg(
        F.bit_count(F.bit_or("mask")).alias("n"), F.max("own").alias("best"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"),
        F.count_if(full).alias("places"), F.min(F.when(full, F.col("diagonal"))).alias("first_place"), F.max(F.when(full, F.col("diagonal"))).alias("last_place"),
    )
    merged = chunks.groupBy(*keys).agg(
        (F.sum("n") / F.first("windows")).alias("score"), (F.max("best") / F.first("windows")).alias("best"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("places").alias("places"), F.min("first_place").alias("first_place"), F.max("last_place").alias("last_place"),
    )
    straight = F.col("last") - F.col("first") <= F.greatest(F.lit(NEIGHBOUR), F.floor(F.col("windows") * DRIFT))
    found = ((F.col("score") >= cover) & straight) | (F.col("best") >= cover)
    return merged.withColumn("accepted", F.when(F.col("is_base"), F.col("places") > 0).otherwise(F.coalesce(found, F.lit(False))))


def scan(docs: DataFrame, found: DataFrame | None = None, cover: float = COVER, max_sent: int = MAX_SENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans for each row of ``docs``; ``found`` are templates (label, text, is_base), else the built-in ones."""
    if found is None:
        found = docs.sparkSession.createDataFrame(templates(), "label string, text string, is_base boolean")
    found = spans(diagonals(docs, materialize(template_table(found), "license-windows"), max_sent), cover)

    def joined(which):
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        found.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"), F.min("first_place").alias("first_word"), F.max("last_place").alias("last_word"),
            joined(F.col("accepted") & F.col("is_base")).alias("base_labels"), joined(F.col("accepted")).alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.count_if("accepted").alias("n_spans"),
        )
        .drop("rid")
    )


def sql(cover: float = COVER) -> str:
    """DuckDB SQL for the query's columns."""
    rows = []
    for tid, (label, text, base) in enumerate(templates()):
        words = text.split()
        rows += [(tid, label, base, len(words) - K + 1, q, " ".join(words[q : q + K])) for q in range(len(words) - K + 1)]
    values = ", ".join(f"({tid}, '{label}', {str(base).lower()}, {n}, {q}, '{gram}')" for tid, label, base, n, q, gram in rows)
    return rf"""
with t(tid, label, is_base, windows, q, gram) as (values {values}),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
g as (select rid, unnest(range(0, len(w) - {K - 1})) as p, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) as gram from d where len(w) >= {K}),
h as (select rid, tid, label, is_base, windows, q, p - q as diagonal from g join t using (gram)),
v as (select rid, tid, label, is_base, windows, diagonal, count(distinct q) as own, list(q) as qs from h group by all),
n as (select *, sum(fresh) over (partition by rid, tid order by diagonal) as span from (select *, case when diagonal - lag(diagonal) over (partition by rid, tid order by diagonal) <= {NEIGHBOUR} then 0 else 1 end as fresh from v)),
m as (select rid, label, is_base, windows, len(list_distinct(flatten(list(qs))))::double / windows as score, max(own)::double / windows as best, max(diagonal) - min(diagonal) as drift, count(*) filter (where is_base and own = windows) as places,
  min(diagonal) filter (where is_base and own = windows) as first_place, max(diagonal) filter (where is_base and own = windows) as last_place from n group by rid, tid, label, is_base, windows, span),
a as (select *, case when is_base then places > 0 else (score >= {cover} and drift <= greatest({NEIGHBOUR}, floor(windows * {DRIFT}))) or best >= {cover} end as accepted from m),
r as (select rid, sum(places) as n_base, min(first_place) as first_word, max(last_place) as last_word, max(score) as score, count(*) filter (where accepted) as n_spans,
  string_agg(distinct label, ',' order by label) filter (where accepted and is_base) as base_labels, string_agg(distinct label, ',' order by label) filter (where accepted) as labels from a group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, 0)::double as score, coalesce(n_spans, 0)::bigint as n_spans from d left join r using (rid)"""
