"""Texts turn into the expected filters, hints and left-over words."""

import pytest

from fieldseq.operators.phrase_plan import plan
from fieldseq.plans.eval_set import EVAL_QUERIES, TRANSLATIONS

TEAMS = ["Barcelona", "Paris Saint-Germain", "Bayer Leverkusen", "England", "England Women's",
         "Spain", "Italy"]


@pytest.fixture(scope="module")
def plans(spark):
    texts = spark.createDataFrame([(q, t) for q, (t, _, _) in EVAL_QUERIES.items()],
                                  "qid string, text string")
    teams = spark.createDataFrame([(t,) for t in TEAMS], "name string")
    return {r["qid"]: r for r in plan(texts, teams).collect()}


@pytest.mark.parametrize("qid", list(TRANSLATIONS))
def test_golden(plans, qid):
    filters, hint, ignored = TRANSLATIONS[qid]
    got = plans[qid]
    assert {k: v for k, v in got["filters"].asDict().items() if v is not None} == filters
    assert got["hint"] == hint
    assert got["ignored"] == ignored
