"""What goes through the detector, and how often the notes to capture are computed."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from notelake.functions import spans
from notelake.operators import lifecycle
from notelake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
#: Texts that hit the rules, and letters that a rule without case takes for others.
PIECES = "Password: ſecret API_KEY toKen pın 1234 1234-1234-1234 ABCDE1234F KA 01 AB 1234 emp id 12345 Badge#A123 h.no 12 Flat 3 MG Road Sector 5, Delhi near the City Hospital Big temple pincode 560001 code +91 98765 43210 Mr. Smith Dr John Doe P-12A a.b@c.d ٣٤ ４５ next to opp. Worker , \n".split(" ")


def every_rule(text):
    """``find_raw`` with all rules over each text."""
    own, people = [], []
    for kind, rule in [(k, spans.re.compile(r)) for k, r in spans.RULES]:
        for m in rule.finditer(text):
            if kind == "person":
                people.append((*m.span(1), kind))
            elif not any(m.start() < e and s < m.end() for s, e, _ in own):
                own.append((*m.span(), kind))
    return sorted(own + people + [(*m.span(), "tag") for m in spans.re.finditer(spans.TAG, text)])


def test_no_rule_that_would_hit_is_left_out():
    rnd, hits = random.Random(3), 0
    for i in range(3000):
        text = rnd.choice(["", " "]).join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 8)))
        text = text.upper() if i % 5 == 0 else text
        want = every_rule(text)
        hits += len(want)
        assert spans.find_raw(text) == want, text
    assert hits > 500


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", ["decide_scope", "apply_override", "preview"])
def test_only_texts_with_a_vector_go_through_the_detector(spark, name):
    lines = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("ArrowEvalPython"))
    below = itertools.takewhile(lambda i: depth[i] > depth[at], range(at + 1, len(lines)))
    assert any(lines[i].lstrip(" :+-").startswith("Join") for i in below)


def test_a_note_to_capture_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def asset(i):
        seen.add(1)
        return None if i % 4 == 0 else f"P-{i % 3}"

    notes = spark.range(40).select(F.col("id").alias("memory_id"), asset("id").alias("asset"), F.col("id").alias("at"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    got = lifecycle.outcomes(notes).collect()
    assert len(got) == 40 and sum(r.asset is None for r in got) == 10
    assert seen.value == 40
