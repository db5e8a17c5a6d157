"""Scalar functions on notes and documents."""

from pyspark.sql import functions as F

from notelake.functions import spans as s
from notelake.functions import text as x
from notelake.plans.registry import query

_WORD = r"\b({})\b".format("|".join(x.RESOLVED))


@query()
def seal_text(t):
    key = F.unhex(F.md5(F.lit("fleet key")))  # a key given by the caller in use
    sealed = F.when(F.col("scope").isin("private", "redacted"), F.concat(F.lit("enc1:"), F.base64(F.aes_encrypt(F.encode("text", "UTF-8"), key)))).otherwise(F.col("text"))
    opened = F.when(F.startswith("sealed", F.lit("enc1:")), F.coalesce(F.decode(F.try_aes_decrypt(F.unbase64(F.expr("substring(sealed, 6)")), key), "UTF-8"), F.lit("[sealed]"))).otherwise(F.col("sealed"))
    return t.notes.withColumn("sealed", sealed).select("memory_id", F.startswith("sealed", F.lit("enc1:")).alias("is_sealed"), (opened == F.col("text")).alias("opens"))


@query(rf"select memory_id, nullif(regexp_extract(text, '{x.ASSET}', 1), '') as asset from notes")
def find_asset(t):
    return t.notes.select("memory_id", x.find_asset(F.col("text")).alias("asset"))


@query()
def detect_spans(t):
    found = s.with_spans(t.documents.select("doc_id", "text"))
    return found.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*", x.in_words(F.col("span.kind"), s.GROUPS).alias("group"))


@query()
def merge_spans(t):
    """Persons by title, before and after touching ones are joined and those under another kind dropped."""
    rows = t.documents.select("doc_id", s.raw_spans("text").alias("raw"))
    people = lambda c: F.filter(c, lambda v: v["kind"] == "person")
    return rows.select("doc_id", F.size(people("raw")).alias("found"), people(s.resolve_spans(F.col("raw"))).alias("spans")).select("doc_id", "found", F.size("spans").alias("n"), F.to_json("spans").alias("spans"))


@query()
def mask_all(t):
    found = s.with_spans(t.documents.select("doc_id", "text"))
    return found.select("doc_id", s.mask_spans(F.col("text"), F.col("spans")).alias("masked"))


_SINGLE = {k: dict(s.RULES)[k] for k in ("email", "id_number", "vehicle")}
_MASKED = "text"
for _kind, _rule in _SINGLE.items():
    _MASKED = f"regexp_replace({_MASKED}, '{_rule}', '[{_kind} removed]', 'g')"


@query(f"select doc_id, {_MASKED} as masked from documents")
def mask_text(t):
    """The rules that need neither look-around nor each other, one after the other."""
    masked = F.col("text")
    for kind, rule in _SINGLE.items():
        masked = x.mask(masked, rule, kind)
    return t.documents.select("doc_id", masked.alias("masked"))


@query(rf"select memory_id, regexp_matches(lower(text), '{_WORD}') as resolved from notes")
def resolved_words(t):
    return t.notes.select("memory_id", x.says_resolved(F.col("text")).alias("resolved"))


@query("select photo_id, round(greatest(0, least(1, (score / 20 - 0.5) / 0.35)), 4) as semantic, round(score / (score + 4), 4) as keyword, round(greatest(0, least(1, (score / 20 - 0.15) / 0.17)), 4) as image from media")
def strength(t):
    c = F.col("score")
    return t.media.select("photo_id", F.round(x.strength(c / 20, "semantic"), 4).alias("semantic"), F.round(x.strength(c, "keyword"), 4).alias("keyword"), F.round(x.strength(c / 20, "image"), 4).alias("image"))


_AGE = "date_diff('day', updated_at::date, date '2001-08-02')"


@query(f"select memory_id, round(1 + 0.08 * exp(-greatest({_AGE}, 0) / 30.0), 6) as boost from notes")
def recency_boost(t):
    return t.notes.select("memory_id", F.round(x.recency(F.datediff(F.lit("2001-08-02"), F.col("updated_at")).cast("double")), 6).alias("boost"))


@query("select doc_id, round(1 / (1 + exp(-(n_chars - 2000) / 500.0)), 6) as p from documents")
def sigmoid(t):
    return t.documents.select("doc_id", F.round(1 / (1 + F.exp(-(F.col("n_chars") - 2000) / 500.0)), 6).alias("p"))


_FLAT = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"


@query(f"select doc_id, case when length({_FLAT}) > 70 then substring({_FLAT}, 1, 69) || '…' else {_FLAT} end as short from documents")
def clip(t):
    return t.documents.select("doc_id", x.clip(F.col("text")).alias("short"))


@query("""select id, case when s < 3600 then greatest(1, round_even(s / 60, 0)::bigint) || ' min' when s < 86400 then round_even(s / 3600, 0)::bigint || ' h' else round_even(s / 86400, 0)::bigint || ' days' end as span,
  case when n < 60 then n || 's' when n < 3600 then (n // 60) || 'm ' || (n % 60) || 's' else (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' end as short
  from (select id, value * 3000 as s, floor(value * 3000)::bigint as n from activity)""")
def duration_text(t):
    seconds = F.col("value") * 3000
    return t.activity.select("id", x.duration(seconds).alias("span"), x.short_duration(seconds).alias("short"))


@query("select run_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024.0) else printf('%.1f MB', n / 1048576.0) end as size from (select run_id, bytes_up * bytes_down as n from sync_runs)")
def bytes_text(t):
    return t.sync_runs.select("run_id", x.bytes_text(F.col("bytes_up") * F.col("bytes_down")).alias("size"))


@query(rf"select memory_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{x.NUMBER}'))), ' ') as numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{x.ASSET}', 1))), ' ') as assets from notes")
def numbers_in(t):
    return t.notes.select("memory_id", F.array_join(x.numbers_in(F.col("text")), " ").alias("numbers"), F.array_join(x.assets_in(F.col("text")), " ").alias("assets"))


@query(rf"select conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' P-1, K-22B and P-1', '{x.ASSET}', 1))), ' ') as assets from conversations")
def assets_in(t):
    return t.conversations.select("conv_id", "turn", F.array_join(x.assets_in(F.concat("text", F.lit(" P-1, K-22B and P-1"))), " ").alias("assets"))


_IN = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"
_POLAR = f"""
with w as (select memory_id, regexp_extract_all(lower(text || ' and it is not safe, no longer faulty'), '[a-z]+') as w from notes),
e as (select memory_id, w, unnest(range(1, len(w) + 1)) as i from w),
v as (select memory_id, w[i] in {_IN(x.POSITIVE)} as good, w[i] in {_IN(x.NEGATIVE)} as bad, len(list_filter(w[greatest(i - 3, 1):i - 1], lambda y: y in {_IN(x.NEGATIONS)})) > 0 as turned from e),
c as (select memory_id, case when (good and not turned) or (bad and turned) then 'positive' when good or bad then 'negative' end as verdict from v)
select memory_id, coalesce(string_agg(distinct verdict, ' ' order by verdict), '') as verdicts from c group by memory_id"""


@query(_POLAR)
def polarity(t):
    return t.notes.select("memory_id", F.array_join(x.polarity(F.concat("text", F.lit(" and it is not safe, no longer faulty"))), " ").alias("verdicts"))


_CASE = lambda c, words: f"case {c} " + " ".join(f"when {k!r} then {v!r}" for k, v in words.items()) + " end"


@query(f"select memory_id, {_CASE('scope', x.SCOPE_WORDS)} as scope_word, {_CASE('priority', x.PRIORITY_WORDS)} as priority_word, {_CASE('category', x.CATEGORY_WORDS)} as category_word from notes")
def label_maps(t):
    return t.notes.select("memory_id", x.in_words(F.col("scope"), x.SCOPE_WORDS).alias("scope_word"), x.in_words(F.col("priority"), x.PRIORITY_WORDS).alias("priority_word"), x.in_words(F.col("category"), x.CATEGORY_WORDS).alias("category_word"))


@query("select memory_id, array_to_string(list_sort(list_distinct(string_split(tag_text || ',pump', ','))), ',') as tags from notes")
def sorted_tags(t):
    return t.notes.select("memory_id", F.array_join(x.sorted_tags(F.split(F.concat("tag_text", F.lit(",pump")), ",")), ",").alias("tags"))


@query("select id, strftime(ts, '%H:%M') as clock, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') as iso, strftime(ts, '%Y-%m-%d') as day from activity")
def local_time(t):
    return t.activity.select("id", F.date_format("ts", "HH:mm").alias("clock"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""
with x as (select memory_id, string_split(b.tag_text, ',') as o, string_split(l.tag_text, ',') as m, string_split(c.tag_text, ',') as h from base_notes b join local_notes l using (memory_id) join cloud_notes c using (memory_id))
select memory_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(o, lambda y: list_contains(m, y) and list_contains(h, y)), list_filter(list_concat(m, h), lambda y: not list_contains(o, y))))), ',') as tags from x""")
def merge_tags(t):
    split = lambda c: F.split(F.col(c), ",")
    rows = t.base_notes.alias("b").join(t.local_notes.alias("l"), "memory_id").join(t.cloud_notes.alias("c"), "memory_id")
    return rows.select("memory_id", F.array_join(x.merge_tags(split("b.tag_text"), split("l.tag_text"), split("c.tag_text")), ",").alias("tags"))


@query(rf"select memory_id, len(list_filter(regexp_extract_all(text, '{x.NUMBER}'), lambda y: not list_contains(regexp_extract_all(coalesce(shared_text, '') || ' 1 2 3 5 10', '{x.NUMBER}'), y))) = 0 as covered from notes")
def subset_test(t):
    allowed = x.numbers_in(F.concat(F.coalesce("shared_text", F.lit("")), F.lit(" 1 2 3 5 10")))
    return t.notes.select("memory_id", (F.size(F.array_except(x.numbers_in(F.col("text")), allowed)) == 0).alias("covered"))


@query()
def signal_types(t):
    return s.with_spans(t.documents.select("doc_id", "text")).select("doc_id", F.array_join(s.kinds_of(F.col("spans")), ",").alias("types"))


@query("""with c as (select memory_id, text, instr(text, 'rea') as p from notes where contains(text, 'rea'))
select memory_id, (p - 1 - length(regexp_extract(substring(text, 1, p - 1), '([\\p{L}\\p{N}]*)$', 1)))::int as start, (p + 2 + length(regexp_extract(substring(text, p + 3), '^([\\p{L}\\p{N}]*)', 1)))::int as "end" from c""")
def whole_words(t):
    """A piece of a word, as a name model finds it, widened to the word."""
    rows = t.notes.where(F.contains("text", F.lit("rea")))
    at = F.instr("text", "rea") - 1
    piece = F.array(F.struct(at.alias("start"), (at + 3).alias("end"), F.lit("person").alias("kind")))
    return rows.select("memory_id", s.whole_words(F.col("text"), piece)[0].alias("w")).select("memory_id", "w.start", "w.end")
