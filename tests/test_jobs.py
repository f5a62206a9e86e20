"""The user-facing jobs end to end on derived tables."""

import pytest
from pyspark.sql import functions as F

from fieldseq.operators import metrics
from fieldseq.operators.filters import Filters
from fieldseq.operators.results import declined
from fieldseq.operators.sparse import corpus, fit_index
from fieldseq.plans import base, jobs
from fieldseq.plans.eval_set import query_table
from fieldseq.sources import corpora, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    items = base.stored_possessions(spark, SF)
    why = declined(F.col("shot_type"), F.col("distance"), F.col("angle"))
    shots = base.shots(spark, SF).withColumn("my_xg", F.when(why.isNull(), F.lit(0.1)))
    return items, shots, fit_index(items, "uid", F.split("token_string", " "))


def test_text_to_results(spark, world):
    items, shots, index = world
    texts = spark.createDataFrame([("a", "T4 counter-attack ending in a shot"),
                                   ("b", "cross into the box")], "qid string, text string")
    plans = jobs.translate(texts, items, aggressive=True)
    by_id = {r.qid: r for r in plans.collect()}
    assert by_id["a"].filters.team == "T4" and by_id["a"].filters.ended_in_shot
    assert by_id["b"].filters.must_include == ["CROSS"]
    assert [t.effect for t in by_id["b"].terms] == ["hint action CROSS", "hint mark >"]
    explicit = query_table(spark, {"a": ("", Filters(ended_in_shot=False), None),
                                   "b": ("", Filters(must_include=("SHOT",)), "SHOT@F-C")})
    merged = jobs.with_explicit(plans, explicit)
    rows = {r.qid: r for r in merged.collect()}
    assert rows["a"].filters.team == "T4" and rows["a"].filters.ended_in_shot is False
    assert rows["b"].hint == "SHOT@F-C" and rows["b"].filters.must_include == ["SHOT"]
    out = jobs.search(merged, items, index, shots=shots, limit=5)
    results = out["results"].collect()
    assert all(r.team == "T4" and not r.ended_in_shot for r in results if r.qid == "a")
    assert all("SHOT" in r.token_string for r in results if r.qid == "b")
    assert {r.ranker for r in out["rankings"].collect()} <= {"sparse"}


def test_shapes_reject_unknown_zones(world):
    with pytest.raises(ValueError, match="X-Y"):
        jobs.shape({"s": ["X-Y"]}, world[0])
    with pytest.raises(ValueError, match="empty"):
        jobs.shape({"s": []}, world[0])


def test_possession_job(spark, world):
    items, shots, index = world
    uid = items.filter("ended_in_shot").orderBy("uid").first().uid
    asked = spark.createDataFrame([(uid,)], "uid string")
    out = jobs.possession(asked, items, base.events(spark, SF), shots)
    assert out["summary"].count() == 1
    events = out["events"].orderBy("idx").collect()
    assert {e.uid for e in events} == {uid}
    assert all(e.token is None for e in events if not e.is_attacking)
    assert out["steps"].count() == len(events)
    assert out["shots"].count() == sum(e.type == "Shot" for e in events)
    assert out["panel"].count() == 1
    seeds = spark.createDataFrame([("s", uid), ("u", "none")], "qid string, uid string")
    more = jobs.similar(seeds, items, index, shots=shots)
    assert [r.qid for r in more["unknown"].collect()] == ["u"]
    assert uid not in {r.uid for r in more["results"].collect()}


def test_audit_pairs_drop_unknown_ids(spark, world):
    items = world[0]
    row = corpus(items).first()
    labels = tables.audit_table(spark, {f"q07|{row.uid}": 1, "q07|no:1": 0})
    got = metrics.audit_pairs(labels, items).collect()
    assert [(r.uid, r.auto) for r in got] == [(row.uid, int("@F-" in row.token_string))]
    summary = metrics.agreement(metrics.audit_pairs(labels, items)).first()
    assert summary.n == 1 and summary.agree + summary.stricter == 1


def test_corpora(spark, tmp_path):
    table = corpora.queries(spark, [{"id": "q1", "text": "t", "filters": {"min_xg": 0.3},
                                     "sequence_hint": "SHOT@F-C"}, {"id": "q2", "text": "u"}])
    rows = {r.qid: r for r in table.collect()}
    assert rows["q1"].filters.min_xg == 0.3 and rows["q2"].filters.must_include is None
    assert corpora.paraphrases(spark, [{"id": "q1", "text": "x", "expect_fail": True}]) \
        .first().expected_failure
    preds = spark.createDataFrame([("e1", "1:2", 1, 0.1, 0.2, 0.3, 9.0, "Open Play", True)],
                                  "event_id string, `group` string, is_goal int, p_base double, "
                                  "p_mine double, p_ref double, distance double, shot_type string, "
                                  "has_freeze_frame boolean")
    tables.write_predictions(preds, str(tmp_path / "p"))
    assert tables.read_predictions(spark, str(tmp_path / "p")).collect() == preds.collect()
