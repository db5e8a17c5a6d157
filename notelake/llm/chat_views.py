"""Multi-party perspective rotation.

Each participant of a conversation gets the dialogue rendered with that speaker
as assistant, all others as users under their names, and system turns as they
are. The spans to train on are the chosen speaker's own words and end marks.

Turns are gathered once per conversation and part, before they are multiplied
by the speakers. A part is ``PART`` turn numbers, or the ``PART`` next of its
rows where turn numbers repeat (``piece``), so that a conversation with a great
share of all rows is many rows of bounded size. A part without the
conversation's first system turn is rendered behind that turn. As every
participant gets every turn, the output is participants times turns.

Defined results: a null or blank role is the speaker ``unknown``; a null text
is empty; repeated rows are turns of their own, and turns that tie are
ordered by speaker and text; a null turn comes first, in part 0, as turn -1; a
null conv_id is one conversation; a conversation of system turns alone has no
participant and no row; ``<|`` in a text is written ``<\\|`` so that no text can
pose as a mark; marks and white space in a name become ``_``, and six letters of
the name's md5 behind ``~`` keep such names apart; an empty table gives no rows;
other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators.ranks import ranked
from notelake.sources.scratch import materialize

PART = 512
#: Crowded parts whose numbers are sent to every task.
MAX_SENT = 200_000
END = "<|end|>\n"


def _opening(speaker: Column, viewer: Column) -> Column:
    safe = F.regexp_replace(speaker, "[|<>\\x00-\\x20]", "_")
    name = F.when(safe == speaker, speaker).otherwise(F.concat(safe, F.lit("~"), F.substring(F.md5(speaker), 1, 6)))
    return F.when(speaker == "system", F.lit("<|system|>\n")).when(speaker == viewer, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with piece: 0, but where a conversation's part has more than ``size`` rows, the number of the ``size`` rows that a row stands among.

    Parts are counted first. Only rows of crowded ones are put in order, all
    together over ranges, so that one turn number with a third of all rows is
    the work of many tasks.
    """
    key = F.struct("conv_id", "part")  # equal where both conv_id are null
    crowded = rows.groupBy(key.alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > size).select("of")
    crowded = materialize(crowded.withColumn("crowded", F.lit(True)), "crowded-parts")
    n = crowded.limit(MAX_SENT + 1).count()
    if n == 0:
        return rows.withColumn("piece", F.lit(0).cast("long"))
    sent = F.broadcast if n <= MAX_SENT else lambda df: df
    marked = rows.withColumn("of", key).join(sent(crowded), "of", "left")
    placed, _ = ranked(materialize(marked.where("crowded").drop("crowded"), "crowded-turns"), F.col("conv_id"), F.col("part"), F.col("turn"), F.col("by"), F.col("text"))
    placed = materialize(placed, "crowded-places")
    first = placed.groupBy("of").agg(F.min("rank").alias("first"))
    placed = placed.join(sent(first), "of").withColumn("piece", F.floor((F.col("rank") - F.col("first")) / size))
    return marked.where("crowded is null").select(*rows.columns, F.lit(0).cast("long").alias("piece")).unionByName(placed.select(*rows.columns, "piece"))


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, speaker, part, piece, n_turns (of the part), rendered and spans (array of start, end in code points) for each participant and part."""
    speaker = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    rows = turns.select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), speaker.alias("by"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("text"))
    rows = rows.withColumn("part", F.greatest(F.floor(F.col("turn") / part), F.lit(0)).cast("long"))
    rows = _pieces(rows, part)
    people = rows.where("by <> 'system'").select(F.col("conv_id").alias("of"), F.col("by").alias("speaker")).distinct()
    leads = rows.where("by = 'system'").groupBy(F.col("conv_id").alias("led")).agg(F.array(F.min(F.struct("turn", "text", "part", "piece"))).alias("leads"))
    parts = rows.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "by", "text"))).alias("turns"))
    parts = parts.join(leads, F.col("conv_id").eqNullSafe(F.col("led")), "left")
    outside = F.filter(F.coalesce("leads", F.array().cast("array<struct<turn:bigint,text:string,part:bigint,piece:bigint>>")), lambda x: F.struct(x["part"], x["piece"]) < F.struct("part", "piece"))
    led = F.transform(outside, lambda x: F.struct(x["turn"].alias("turn"), F.lit("system").alias("by"), x["text"].alias("text")))
    views = parts.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "part", "piece", F.size("turns").cast("long").alias("n_turns"), F.concat(led, "turns").alias("turns"), "speaker")
    viewer = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(_opening(t["by"], viewer).alias("open"), F.concat(t["text"], F.lit(END)).alias("said"), (t["by"] == viewer).alias("own")))
    views = views.withColumn("pieces", pieces).drop("turns")
    # Where each piece begins, and of the viewer's pieces the words behind the opening.
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["open"]).alias("open"), F.length(p["said"]).alias("said"), p["own"].alias("own")))
    ends = F.aggregate("sizes", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["open"] + p["said"])))
    own = F.zip_with("sizes", F.slice("ends", 1, F.size("sizes")), lambda p, at: F.when(p["own"], F.struct((at + p["open"]).alias("start"), (at + p["open"] + p["said"]).alias("end"))))
    views = views.withColumn("sizes", sizes).withColumn("ends", ends)
    spans = F.filter(own, lambda x: x.isNotNull())
    return views.select("conv_id", "speaker", "part", "piece", "n_turns", F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["said"])), "").alias("rendered"), spans.alias("spans"))


def digest(views: DataFrame) -> DataFrame:
    """The query's columns: counts and the md5 of the rendering and of the words trained on."""
    own = F.transform("spans", lambda s: F.substring(F.col("rendered"), s["start"] + 1, s["end"] - s["start"]))
    return views.select(
        "conv_id", "speaker", "part", "piece", "n_turns", F.size("spans").cast("long").alias("n_own"), F.length("rendered").cast("long").alias("n_chars"),
        F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("n_train_chars"), F.md5("rendered").alias("rendered_md5"), F.md5(F.array_join(own, "")).alias("train_md5"),
    )


def sql(part: int = PART) -> str:
    """DuckDB SQL for the query's columns."""
    return rf"""
with t0 as (select conv_id, coalesce(turn, -1) as turn, coalesce(nullif(trim(role, ' '), ''), 'unknown') as who, replace(coalesce(text, ''), '<|', '<\|') as text from conversations),
t1 as (select *, greatest(floor(turn / {part}), 0)::bigint as part from t0),
t as (select *, ((row_number() over (partition by conv_id, part order by turn, who, text) - 1) // {part})::bigint as piece from t1),
p as (select distinct conv_id, who as speaker from t where who <> 'system'),
lead_ as (select conv_id, turn, text, part, piece from (select *, row_number() over (partition by conv_id order by turn, text, part, piece) as k from t where who = 'system') where k = 1),
cells as (select distinct conv_id, part, piece from t),
x as (select conv_id, turn, who, text, part, piece, 1 as own_turn from t
  union all select c.conv_id, l.turn, 'system', l.text, c.part, c.piece, 0 from cells c join lead_ l on c.conv_id is not distinct from l.conv_id where (l.part, l.piece) < (c.part, c.piece)),
v as (select p.conv_id, p.speaker, x.turn, x.who, x.text, x.part, x.piece, own_turn,
  case when x.who = 'system' then '<|system|>' || chr(10) when x.who = p.speaker then '<|assistant|>' || chr(10)
    else '<|user name=' || regexp_replace(x.who, '[|<>\x00-\x20]', '_', 'g') || case when regexp_replace(x.who, '[|<>\x00-\x20]', '_', 'g') = x.who then '' else '~' || substr(md5(x.who), 1, 6) end || '|>' || chr(10) end as open,
  x.text || '<|end|>' || chr(10) as said, x.who = p.speaker as own from p join x on p.conv_id is not distinct from x.conv_id)
select conv_id, speaker, part, piece, sum(own_turn)::bigint as n_turns, count(*) filter (where own) as n_own, sum(length(open) + length(said))::bigint as n_chars, coalesce(sum(length(said)) filter (where own), 0)::bigint as n_train_chars,
  md5(string_agg(open || said, '' order by own_turn, turn, who, text)) as rendered_md5, md5(coalesce(string_agg(said, '' order by own_turn, turn, who, text) filter (where own), '')) as train_md5 from v group by conv_id, speaker, part, piece"""
