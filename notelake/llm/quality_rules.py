"""Quality rules whose cutoffs carry a guarantee.

``measure`` adds the metrics of a whole text with built-in functions inside one
row, so nothing is shuffled. ``select_cutoffs`` tests every cutoff of a fixed
grid on the labelled rows: the null hypothesis is that the rule rejects at
least ``alpha / rules`` of a stratum's good documents, its p-value is the exact
binomial tail over distinct texts, and Holm's step-down over all cells keeps the chance of any
invalid cutoff at ``delta``. The grid is fixed beforehand, so every labelled
row is a holdout row. Of a rule's
valid cutoffs the one with the best balance of bad and good documents rejected
is used. ``apply_rules`` rejects what fails the base rule or exceeds a cutoff
of its stratum.

Defined results: a null text has no words and fails the base rule; rows that
repeat a doc_id are judged one by one; a document with several labels counts as
good if any of them says so; labels with a null are not used; in the holdout a
doc_id counts once (with its text of the least md5), and so does a text, which
is good if any of its labels says so and stands in the stratum of its least
doc_id; a stratum with
too few labels gets no cutoff, so its rules stay off; empty tables give empty
results. Columns other than those named here are carried through untouched
unless they are metrics of the same name, which are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.sources.scratch import materialize

#: Strata are these languages and "other": the cutoff table has a proven bound.
STRATA = ("de", "en", "es", "fr")
#: Rule -> cutoffs; a document breaks a rule if its ratio is above the cutoff.
GRID = {
    "symbol_ratio": (0.05, 0.1, 0.2, 0.4, 0.8, 1.6),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.4),
    "upper_ratio": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "mean_word": (8.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
ALPHA, DELTA = 0.05, 0.05
#: Of the valid cutoffs of a rule, that is taken which rejects most bad documents, where a good one counts as so many.
COST = 10
#: Terms of the binomial tail that are summed; a geometric bound covers the rest from above.
TAIL = 2000
_TMP = ("_q_text", "_q_words", "_q_lines", "_q_wins", "_q_sorted")


def measure(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, text_md5, base_failed and stratum."""
    d = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    if drop_text:
        d = d.drop(text)
    t = F.col("_q_text")
    d = d.withColumns(
        {
            "_q_words": F.array_remove(F.split(t, "[ \\t-\\r]+"), ""),
            "_q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "text_md5": F.md5(t),
            "n_upper": (F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", ""))).cast("long"),
        }
    ).drop("_q_text")
    w = F.col("_q_words")
    at = lambda i, k: F.get(w, i + k)
    d = d.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_wins": F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5))))).otherwise(F.array().cast("array<long>")),
        }
    ).drop("_q_words", "_q_lines")
    # Only texts with a repeated window pay for the sort.
    wins = F.col("_q_wins")
    d = d.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct(wins)) < F.size(wins),
            F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("_q_wins")
    s = F.col("_q_sorted")
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", covered.cast("long")).drop("_q_sorted")
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    if "lang" in docs.columns:
        return d.withColumn("stratum", F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other"))
    return d.withColumn("stratum", F.lit("other"))


def ratio(rule: str) -> Column:
    """The value that a rule compares with its cutoff; null where it is undefined, which breaks no rule."""
    over = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "upper_ratio": ("n_upper", "word_chars"), "mean_word": ("word_chars", "n_words")}
    a, b = over[rule]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def _ln_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence; x >= 1."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the last ``TAIL`` terms exactly and a bound from above for those below them."""
    n_, lo = n.cast("double"), F.greatest(F.lit(0), k - TAIL).cast("long")

    def term(i: Column) -> Column:
        x = i.cast("double")
        return F.exp(_ln_gamma(n_ + 1) - _ln_gamma(x + 1) - _ln_gamma(n_ - x + 1) + x * F.log(F.lit(p)) + (n_ - x) * F.log(F.lit(1 - p)))

    r = lo * (1 - p) / ((n_ - lo + 1) * p)
    rest = F.when(lo == 0, 0.0).when(r < 1, term(lo) * r / (1 - r)).otherwise(1.0)
    return F.least(F.lit(1.0), F.aggregate(F.sequence(lo, k.cast("long")), F.lit(0.0), lambda a, i: a + term(i)) + rest)


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid: dict = GRID) -> DataFrame:
    """One row for each stratum with labels: stratum and, for each rule, its cutoff or null. ``measured`` needs doc_id."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).alias("_good"))
    own = F.struct("stratum", *(ratio(r).alias(r) for r in grid))
    rows = measured.where(~F.col("base_failed")).select("doc_id", F.struct("text_md5", own.alias("own")).alias("x")).join(good, "doc_id")
    # A trial is a text: rows that repeat a doc_id, and copies under other ids, are not independent of each other.
    rows = rows.groupBy("doc_id", "_good").agg(F.min("x").alias("x"))
    rows = rows.groupBy("x.text_md5").agg(F.max("_good").alias("_good"), F.min(F.struct("doc_id", "x.own")).alias("x")).select("_good", "x.own.*")
    cells = [(r, c) for r in grid for c in grid[r]]
    counts = rows.groupBy("stratum").agg(
        F.count_if("_good").alias("n"),
        *(F.count_if(F.col("_good") & (F.col(r) > c)).alias(f"g{j}") for j, (r, c) in enumerate(cells)),
        *(F.count_if(~F.col("_good") & (F.col(r) > c)).alias(f"b{j}") for j, (r, c) in enumerate(cells)),
    )
    tests = counts.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"g{j}").alias("k"), F.col(f"b{j}").alias("bad")) for j, (r, c) in enumerate(cells)))).alias("x")).select("stratum", "n", "x.*")
    m = (len(STRATA) + 1) * len(cells)
    tests = tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha / len(grid)))
    # At most strata x cells rows: 150 with the defaults.
    order = Window.orderBy("p", "stratum", "rule", "cutoff")
    tests = tests.withColumn("holm", F.col("p") * (m + 1 - F.row_number().over(order)))
    valid = tests.withColumn("worst", F.max("holm").over(order)).where(F.col("worst") <= delta)
    gain = F.col("bad") - COST * F.col("k")
    best = F.max_by("cutoff", F.struct(gain, F.col("cutoff")))
    chosen = valid.where(gain > 0).groupBy("stratum", "rule").agg(best.alias("cutoff"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in grid))


def apply_rules(measured: DataFrame, cutoffs: DataFrame, grid: dict = GRID) -> DataFrame:
    """``measured`` with kept and broken_rule: base, the first rule broken in grid order, or null."""
    d = measured.join(F.broadcast(cutoffs), "stratum", "left")  # a row for each stratum, six at most
    broken = F.when(F.col("base_failed"), F.lit("base"))
    for r in grid:
        broken = broken.when(ratio(r) > F.col(f"cut_{r}"), F.lit(r))
    d = d.withColumn("broken_rule", broken)
    return d.withColumn("kept", F.col("broken_rule").isNull()).drop(*(f"cut_{r}" for r in grid))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Verdict and metrics for each row of ``docs`` (without its text)."""
    measured = materialize(measure(docs.select("doc_id", "text", "lang"), drop_text=True), "quality")
    return apply_rules(measured, select_cutoffs(measured, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text", "lang")
    measured = materialize(measure(inner, drop_text=True), "quality")
    return apply_rules(measured, select_cutoffs(measured, labels, alpha, delta)).where("kept").select("_row.*")


def sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB SQL for the query's columns."""
    cells = [(r, c) for r in GRID for c in GRID[r]]
    over = {"symbol_ratio": "n_symbols / n_words", "dup_line_ratio": "n_dup_lines / n_lines", "repeat_ratio": "n_repeat_words / n_words", "upper_ratio": "n_upper / word_chars", "mean_word": "word_chars / n_words"}
    ratios = {r: f"case when {e.split(' / ')[1]} > 0 then {e.replace(' / ', '::double / ')} end" for r, e in over.items()}
    tests = " union all ".join(f"select stratum, '{r}' as rule, {c}::double as cutoff, count(*) filter (where good) as n, count(*) filter (where good and {r} > {c}) as k, count(*) filter (where not good and {r} > {c}) as bad from lab group by stratum" for r, c in cells)
    a, m = alpha / len(GRID), (len(STRATA) + 1) * len(cells)
    broken = " ".join(f"when {ratios[r]} > (select cutoff from chosen c where c.stratum = d.stratum and c.rule = '{r}') then '{r}'" for r in GRID)
    return rf"""
with base as (select row_number() over () as r, doc_id, coalesce(text, '') as t, case when lang in {STRATA} then lang else 'other' end as stratum from documents),
w as (select r, doc_id, t, stratum, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from base),
win as (select r, unnest(range(1, len(words) - 3)) as i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) as g from w where len(words) >= 5),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
cover as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
m as (select w.r, doc_id, stratum, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as n_upper,
  len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join cover using (r)),
d as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
good as (select doc_id, max(quality) = 1 as good from labels where quality is not null group by doc_id),
lab1 as (select doc_id, md5(t) as h, stratum, good, {', '.join(f'{e} as {r}' for r, e in ratios.items())} from d join good using (doc_id) where not base_failed),
lab2 as (select * from lab1 qualify row_number() over (partition by doc_id order by h, stratum) = 1),
lab as (select * exclude (good), max(good) over (partition by h) as good from lab2 qualify row_number() over (partition by h order by doc_id) = 1),
tests as ({tests}),
tail as (select *, (select coalesce(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a}))), 0) from range(0, k + 1) as s(i)) as p from tests),
holm as (select *, p * ({m} + 1 - row_number() over (order by p, stratum, rule, cutoff)) as h from tail),
worst as (select *, max(h) over (order by p, stratum, rule, cutoff) as worst from holm),
chosen as (select stratum, rule, arg_max(cutoff, (bad - {COST} * k) * 1000 + cutoff) as cutoff from worst where worst <= {delta} and bad > {COST} * k group by stratum, rule),
v as (select d.*, case when base_failed then 'base' {broken} end as broken_rule from d)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  base_failed, broken_rule is null as kept, broken_rule from v"""


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rule")
