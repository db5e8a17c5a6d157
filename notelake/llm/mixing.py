"""Mixing sources to target weights, block by block.

Each source's documents are laid end to end and cut into blocks of ``BLOCK``
words. The output is shards of ``SHARD`` slots, a block each. For every shard
the number of slots of each source is drawn from the multinomial distribution
of the targets (each slot draws by hashing its place). A source gets as many
blocks as were drawn for it; only where that is further than ``TOLERANCE`` from
its target's blocks, as with few slots, or more than twice its blocks, it stops
at that bound: slots beyond it go to sources that are short of theirs or stay
out, and what is still short fills further shards. The j-th slot of a source
takes the block that the source's pseudorandom permutation of block numbers
(swap-or-not rounds, which permute any range) gives for j, and the slots are
joined with the blocks by number. No block is taken more often than twice.

Every step is DataFrame functions. Positions within a source come from prefix
sums over buckets of its documents, so a source with a third of all rows is
spread over many tasks; the slots' sources are found by joining on grid cells.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; rows that repeat a doc_id are separate
documents (those of one size are in one bucket); if all sizes are 0 nothing is taken and targets are 0; an empty
table gives no rows; columns other than doc_id, text and source are not read by
``mix`` and are carried by ``take``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.sources.scratch import materialize

WEIGHTS = (3, 1, 2)
SHARE, STOP = 1.5, 2
BLOCK, SHARD, ROUNDS, SEED = 256, 4096, 24, 7
#: A source's documents in a bucket of its prefix sums; grid cells of an interval join (at least), and the widest cell, so that cells grow in number with the data.
BUCKET, CELLS, WIDEST = 1_000, 1024, 1 << 16
#: Share of a source's blocks by which its draws may miss them.
TOLERANCE = 0.02


def _hash(*parts: Column | str | int) -> Column:
    """60 bits of the md5 of the parts."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, *carry: str) -> DataFrame:
    """rid, doc_id, source, size (words of the text) and the columns of ``carry``, written once."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")
    return materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", size.alias("size"), *carry), "mix-sizes")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, stop: float = STOP) -> DataFrame:
    """A row for each source: source, sid, source_size, n_docs (with words), target, blocks and quota.

    Weights repeat over the sources in code point order. A target above
    ``stop`` times its source's size stops there, and the rest is shared by
    weight among the others: sorted by the level at which they stop, the ones
    that stop are a prefix, so running sums find the common level.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1).cast("double")).withColumn("cap", F.col("source_size") * float(stop))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "wanted": F.sum("source_size").over(every) * share,
            "rest": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
            "stopped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        }
    )
    s = s.withColumn("level", (F.col("wanted") - F.col("stopped")) / F.col("rest"))
    s = s.withColumn("common", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap"), F.col("common") * F.col("w")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0)
    return s.select("source", "sid", "source_size", "n_docs", "target", "blocks", quota.cast("long").alias("quota"))


def _place(points: DataFrame, x: str, intervals: DataFrame, span: int) -> DataFrame:
    """``points`` joined with the interval [lo, hi) that holds ``x``; intervals are disjoint parts of [0, span)."""
    width = max(1, min(-(-span // CELLS), WIDEST))
    cut = intervals.where("lo < hi").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col(x) / width)).join(cut, "_cell").where((F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi"))).drop("_cell", "lo", "hi")


def permute(x: Column, n: Column, keys: Column, name: Column) -> Column:
    """Swap-or-not: in each round x and its mirror (key - x) mod n change places or not, by a hashed bit of the larger."""

    def turn(a: Column, r: Column) -> Column:
        mirror = F.pmod(F.get(keys, r) - a, n)
        bit = F.ascii(F.substring(F.md5(F.concat_ws(":", name, r.cast("string"), F.greatest(a, mirror).cast("string"))), 1, 1)) % 2
        return F.when(bit == 1, mirror).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, turn)


def plan(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, slot, sid, block and turn (how often the block was taken before) for every slot of the output."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    slots = spark.range(total).select(F.floor(F.col("id") / SHARD).alias("shard"), (F.col("id") % SHARD).alias("slot"))
    order = Window.orderBy("sid")
    shares = sources.select("sid", "quota", F.sum("quota").over(order).alias("hi")).withColumn("lo", F.col("hi") - F.col("quota"))
    drawn = slots.withColumn("x", F.pmod(_hash("draw", seed, F.col("shard"), F.col("slot")), F.lit(max(1, total))))
    drawn = materialize(_place(drawn, "x", shares.select("sid", "lo", "hi"), total).select("shard", "slot", "sid"), "mix-draws")

    counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("sid", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    ranked = drawn.withColumn("k", rank).join(base, ["sid", "shard"]).select("shard", "slot", "sid", (F.col("base") + F.col("k")).alias("j"))

    held = sources.select("sid", "quota", "blocks").join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    slack = F.floor(F.col("quota") * TOLERANCE)
    held = held.withColumn("count", F.least(F.greatest("n", F.col("quota") - slack), F.col("quota") + slack, F.floor(F.col("blocks") * STOP)))
    held = held.withColumns({"over": F.greatest(F.col("n") - F.col("count"), F.lit(0)), "short": F.greatest(F.col("count") - F.col("n"), F.lit(0))})
    held = held.withColumns({"over_hi": F.sum("over").over(order), "hi": F.sum("short").over(order)}).withColumn("lo", F.col("hi") - F.col("short"))
    held = materialize(held, "mix-held")
    over, short = held.agg(F.coalesce(F.sum("over"), F.lit(0)), F.coalesce(F.sum("short"), F.lit(0))).first()
    marked = ranked.join(held.select("sid", "count", (F.col("over_hi") - F.col("over")).alias("over_lo")), "sid")
    surplus = marked.where("j >= count").select("shard", "slot", (F.col("over_lo") + F.col("j") - F.col("count")).alias("x"))
    # What all surplus slots leave short gets shards of its own behind the others.
    added = spark.range(max(0, short - over)).select(F.floor(F.col("id") / SHARD).alias("k"), (F.col("id") % SHARD).alias("slot"), (F.col("id") + over).alias("x"))
    surplus = surplus.unionByName(added.select((F.col("k") + -(-total // SHARD)).alias("shard"), "slot", "x"))
    moved = _place(surplus, "x", held.select(F.col("sid").alias("to"), "n", F.col("lo").alias("from"), "lo", "hi"), short)
    moved = moved.select("shard", "slot", F.col("to").alias("sid"), (F.col("n") + F.col("x") - F.col("from")).alias("j"))
    dealt = marked.where("j < count").select("shard", "slot", "sid", "j").unionByName(moved)

    name = F.concat_ws(":", F.lit("order"), F.lit(str(seed)), F.col("sid").cast("string"))
    keys = sources.where("blocks > 0").select("sid", "blocks", name.alias("name"), F.array(*(F.pmod(_hash("key", seed, F.col("sid"), r), F.col("blocks")) for r in range(ROUNDS))).alias("keys"))
    dealt = dealt.join(keys, "sid")
    at = permute(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("keys"), F.col("name"))
    return dealt.select("shard", "slot", "sid", at.alias("block"), F.floor(F.col("j") / F.col("blocks")).alias("turn"))


def _laid_out(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """rid, sid and start (words of the source before the document) for documents with words."""
    sids = sources.select("source", "sid", F.greatest(F.ceil(F.col("n_docs") / BUCKET), F.lit(1)).alias("buckets"))
    ids = sized.where("size > 0").join(sids, sized["source"].eqNullSafe(sids["source"])).select("rid", "doc_id", "size", "sid", "buckets")
    ids = ids.withColumn("bucket", F.pmod(_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")), F.col("buckets"))).drop("buckets")
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ids.groupBy("sid", "bucket").agg(F.sum("size").alias("all")).select("sid", "bucket", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("sid", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return ids.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(before, ["sid", "bucket"]).select("rid", "sid", "size", (F.col("before") + F.col("within")).alias("start"))


def pieces(sized: DataFrame, sources: DataFrame, slots: DataFrame) -> DataFrame:
    """rid, block, lo, n (words lo to lo + n of the document) and uses: each document's part of each block, joined with the slots by block number."""
    uses = slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    laid = _laid_out(sized, sources)
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    lo = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))
    cut = cut.select("rid", "sid", "block", lo.alias("lo"), (hi - lo).alias("n"))
    return cut.join(uses, ["sid", "block"], "left").select("rid", "block", "lo", "n", F.coalesce("uses", F.lit(0)).alias("uses"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of the source) and taken (words, repeats counted) for each row of ``docs``."""
    sized = sizes(docs)
    sources = materialize(targets(sized), "mix-sources")
    taken = pieces(sized, sources, plan(sources, seed)).groupBy("rid").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    rows = sized.join(taken, "rid", "left")
    per = sources.select(F.col("source").alias("of"), "source_size", "target")
    return rows.join(per, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def take(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each document and turn with words in it.

    A document taken whole keeps its text as it is; else the text is the words
    of its taken blocks, in order, with single spaces.
    """
    inner = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    sized = sizes(inner, "_row")
    sources = materialize(targets(sized), "mix-sources")
    cut = pieces(sized.select("rid", "doc_id", "source", "size"), sources, plan(sources, seed))
    parts = cut.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "uses"))).alias("parts"))  # one document's own blocks
    turns = parts.where(F.exists("parts", lambda p: p["uses"] > 0)).select("rid", "parts", F.explode(F.sequence(F.lit(0), F.array_max(F.transform("parts", lambda p: p["uses"])).cast("int") - 1)).alias("turn"))
    own = F.filter("parts", lambda p: p["uses"] > F.col("turn"))
    turns = turns.select("rid", own.alias("own"), (F.size(own) == F.size("parts")).alias("whole"))
    rows = sized.select("rid", "_row").join(turns, "rid").withColumn("_words", F.when(~F.col("whole"), F.array_remove(F.split("_row.text", "[ \\t-\\r]+"), "")))
    some = F.array_join(F.flatten(F.transform("own", lambda p: F.slice(F.col("_words"), (p["lo"] + 1).cast("int"), p["n"].cast("int")))), " ")
    rows = rows.withColumn("_text", F.when(F.col("whole"), F.col("_row.text")).otherwise(some))
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*(fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def sql(weights=WEIGHTS, share: float = SHARE, stop: float = STOP, seed: int = SEED) -> str:
    """DuckDB SQL for the query's columns, with its own draws."""

    def h(text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, 15))::bigint"

    return rf"""
with d as (select row_number() over () as rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size, count(*) filter (where size > 0) as n_docs, row_number() over (order by source nulls last) as sid from d group by source),
s1 as (select *, ([{', '.join(f'{w}.0::double' for w in weights)}])[(sid - 1) % {len(weights)} + 1] as w, source_size * {float(stop)}::double as cap from s0),
s2 as (select *, (sum(source_size) over ())::double * {share}::double as wanted, (sum(w) over ()) - coalesce(sum(w) over o, 0) as rest, coalesce(sum(cap) over o, 0) as stopped from s1 window o as (order by cap / w, sid rows between unbounded preceding and 1 preceding)),
s3 as (select *, (wanted - stopped) / rest as level from s2),
s4 as (select *, (select level from s3 where level <= cap / w order by cap / w, sid limit 1) as common from s3),
s as (select source, sid, source_size, n_docs, least(cap, common * w) as target, ceil(source_size / {BLOCK}.0)::bigint as blocks from s4),
q as (select *, case when source_size > 0 then floor(target * blocks / source_size + 0.5)::bigint else 0 end as quota from s),
shares as (select sid, quota, sum(quota) over (order by sid)::bigint as hi, (select sum(quota) from q)::bigint as total from q),
slots as (select unnest(range(0, (select coalesce(max(total), 0) from shares))) as i),
drawn as (select {h(f"'draw:{seed}:' || (i // {SHARD}) || ':' || (i % {SHARD})")} % (select greatest(1, max(total)) from shares) as x from slots),
n as (select sid, count(*) as n from drawn join shares on x >= hi - quota and x < hi group by sid),
c as (select q.sid, blocks, least(greatest(coalesce(n, 0), quota - floor(quota * {TOLERANCE}::double)), quota + floor(quota * {TOLERANCE}::double), blocks * {STOP})::bigint as count from q left join n using (sid)),
j as (select sid, blocks, unnest(range(0, count)) as j from c where count > 0),
p as (select sid, list_reduce(list_prepend(j % blocks, range(0, {ROUNDS})), lambda x, r: case when ascii(substr(md5('order:{seed}:' || sid || ':' || r || ':' || greatest(x, ((({h(f"'key:{seed}:' || sid || ':' || r")} % blocks) - x) % blocks + blocks) % blocks)), 1, 1)) % 2 = 1
  then ((({h(f"'key:{seed}:' || sid || ':' || r")} % blocks) - x) % blocks + blocks) % blocks else x end) as block from j),
uses as (select sid, block, count(*) as uses from p group by all),
b as (select d.rid, d.doc_id, d.size, q.sid, {h("coalesce(doc_id::varchar, '') || ':' || size")} % greatest(1, ceil(n_docs / {BUCKET}.0)::bigint) as bucket from d join q on d.source is not distinct from q.source where size > 0),
l as (select rid, sid, size, coalesce(sum(size) over (partition by sid order by bucket, doc_id nulls first, size, rid rows between unbounded preceding and 1 preceding), 0)::bigint as start from b),
cut as (select rid, sid, size, start, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) as block from l),
t as (select rid, sum((least((c.block + 1) * {BLOCK}, start + size) - greatest(c.block * {BLOCK}, start)) * coalesce(uses, 0)) as taken from cut c left join uses u on u.sid = c.sid and u.block = c.block group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from d join q on d.source is not distinct from q.source left join t using (rid)"""
