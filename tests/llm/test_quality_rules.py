import math
import re

from pyspark.sql import functions as F

from notelake.llm import quality_rules as q
from tests.llm.conftest import rows

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in wins:
        count[x] = count.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(wins) if count[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_metrics_match_brute_force(spark, docs):
    extra = ["a a a a a a a", "x y z " * 40, "l1\nl1\n\n \nl2\nl1", "a b c d e f a b c d e g a b c d e"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    got = q.measure(docs.select("doc_id", "text").unionByName(more)).collect()
    assert len(got) == len(rows()) + len(extra)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 50), (10, 10), (0, 0), (40, 5000), (900, 100_000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", q.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for k, n, p in got:
        true = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert abs(p - min(1, true)) < 1e-9


def test_cutoffs_keep_good_documents_and_reject_bad(spark):
    good = [(i, " ".join(f"g{i}q{j}" for j in range(40)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"b{i}q{j}###" for j in range(40)), "en") for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 5000), 0) for i, *_ in good + bad], LABELS)
    out = q.judge(docs, labels)
    assert out.where("doc_id < 5000 and not kept").count() == 0
    assert out.where("doc_id >= 5000 and broken_rule = 'symbol_ratio'").count() == 300
    # Too few labels for a guarantee: the rule stays off.
    assert q.judge(docs, labels.where("doc_id % 40 = 0")).where("not kept").count() == 0


def test_odd_inputs(spark, docs, empty):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 1), (8, 1, 0), (8, 0, 0), (8, 1, 0)], LABELS)
    assert q.judge(docs, labels).count() == len(rows())
    kept = q.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert kept.count() == q.judge(docs, labels.limit(0)).where("kept").count()
    assert q.judge(empty, labels).count() == 0


def test_repeats_and_copies_change_no_cutoff(spark):
    good = [(i, " ".join(f"g{i}q{j}" for j in range(40)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(f"b{i}q{j}###" for j in range(40)), "en") for i in range(300)]
    label = lambda rows: spark.createDataFrame([(i, int(i < 5000 or i >= 10_000), 0) for i, *_ in rows], LABELS)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cut = lambda rows: sorted(map(str, q.select_cutoffs(q.measure(docs(rows)), label(rows)).collect()))
    want = cut(good + bad)
    assert len(want) == 1 and "cut_symbol_ratio=None" not in want[0]
    copies = [(10_000 + i, good[0][1], "en") for i in range(2000)] + [good[1]] * 500
    assert cut(good + bad + copies) == want
    # One good text, however often it stands there, proves nothing.
    assert cut([good[0]] * 2000 + bad[:1]) == [] == cut([(10_000 + i, good[0][1], "en") for i in range(2000)] + bad[:1])
