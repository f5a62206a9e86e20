"""No task and no driver holds more than a bounded part of a table."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from fieldseq.operators import metrics, predicate_index, shapes
from fieldseq.operators.filters import FILTER_TYPE, Filters
from fieldseq.operators.skew import SPREAD, spread_join
from fieldseq.plans.catalog import QUERIES
from fieldseq.sources.tables import written


def plan_of(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def test_copies_of_a_table_are_not_broadcast_for_its_size(spark):
    rows = spark.range(2_000_000).select((F.col("id") % 30_000).alias("k"), "id")
    table = spark.range(30_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = spread_join(rows, table, ["k"], F.col("id"))
    assert "SortMergeJoin" in plan_of(joined)
    assert joined.filter(F.col("v") == F.col("k") * 2).count() == 2_000_000


def test_copies_of_a_small_table_are_broadcast(spark):
    rows = spark.range(1_000).select((F.col("id") % 3).alias("k"), "id")
    joined = spread_join(rows, spark.range(3).select(F.col("id").alias("k")), ["k"], F.col("id"))
    assert "BroadcastHashJoin" in plan_of(joined)
    assert joined.count() == 1_000 and SPREAD == 64


def test_paths_of_filtered_shapes_are_not_broadcast(spark, monkeypatch):
    items = spark.createDataFrame(
        [("u", "T", "O", "C", "S", "Regular Play", "D-C", "F-C", True, False, 0.1, 3, "PASS@D-C PASS@M-C SHOT@F-C",
          "D-C M-C F-C")],
        "uid string, team string, opponent string, competition string, season string, play_pattern string, "
        "start_zone string, end_zone string, ended_in_shot boolean, ended_in_goal boolean, xg_sum double, "
        "n_events int, token_string string, zone_path string")
    schema = spark.createDataFrame([], "qid string, zones array<string>").schema.add("filters", FILTER_TYPE)
    drawn = spark.createDataFrame([("s", ["D-C", "F-C"], Filters(ended_in_shot=True).as_row()),
                                   ("t", ["D-C"], Filters(ended_in_shot=False).as_row())], schema)
    plans, stored = {}, shapes.written

    def noted(df, name):
        plans[name] = plan_of(df, "extended")
        return stored(df, name)
    monkeypatch.setattr(shapes, "written", noted)
    found = shapes.matches(items, drawn).collect()
    assert [(r.qid, r.uid) for r in found] == [("s", "u")]
    assert "leftHint=(strategy=merge)" in plans["paths"]


def test_paths_offered_to_many_shapes_are_not_broadcast(spark):
    zones = ["D-L", "M-L", "F-L", "D-C", "M-C", "F-C", "D-R", "M-R", "F-R", "D-LI"]
    ways = [(a, b, c, d) for a in zones for b in zones for c in zones for d in zones if a != b and b != c and c != d]
    drawn = spark.createDataFrame([(" ".join(w), list(w)) for w in ways], "qid string, zones array<string>")
    items = spark.createDataFrame([(f"u{i}", 4, " ".join(w)) for i, w in enumerate(ways)],
                                  "uid string, n_events int, zone_path string")
    found = shapes.matches(items, drawn)
    assert not [line for line in plan_of(found).splitlines() if "BroadcastHashJoin" in line]
    assert found.select("uid").distinct().count() == len(ways) and found.count() == len(ways)


def test_lines_of_audited_possessions_are_not_broadcast(spark):
    lines = spark.createDataFrame([("u1", "PASS@M-C SHOT@F-C", "M-C F-C", 2, True), ("u2", "PASS@D-C", "D-C", 1, False)],
                                  "uid string, token_string string, zone_path string, n_events int, ended_in_shot boolean")
    labels = spark.createDataFrame([("q01", "u1", 1), ("q01", "u2", 0), ("q01", "none", 1)],
                                   "qid string, uid string, human int")
    pairs = metrics.audit_pairs(labels, written(lines, "lines"))
    assert "Broadcast" not in plan_of(pairs)
    assert sorted((r.uid, r.human) for r in pairs.collect()) == [("u1", 1), ("u2", 0)]


def test_numbers_items_hold_are_not_broadcast(spark):
    held = written(spark.range(300).select(
        F.concat(F.lit("u"), "id").alias("uid"), F.array(F.col("id") % 3, 3 + F.col("id") % 2).alias("held"),
        F.lit(0.5).alias("xg_sum"), F.lit(4).cast("long").alias("n_events")), "held")
    needs = written(spark.createDataFrame([("a", [0, 3], None, None), ("b", [2], None, 5), ("c", [4], 0.1, None)],
                                          "qid string, needs array<bigint>, min_xg double, min_events int"), "needs")
    for options, join in (({}, "BroadcastHashJoin"), ({"few": 0}, "SortMergeJoin")):
        found = predicate_index.candidates(needs, held, **options)
        plan = plan_of(found)
        assert join in plan and "BuildLeft" not in plan
        assert {r.qid: r["count"] for r in found.groupBy("qid").count().collect()} == {"a": 50, "c": 150}


@pytest.mark.parametrize("name", ["xg_baseline_fit", "xg_ensemble_fit"])
def test_rows_of_a_fit_are_joined_once(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "/rows" in plan and "Join" not in plan
