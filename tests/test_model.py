"""Prediction metrics, order statistics and the expected-goals model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldseq.operators import order_stats, xg
from fieldseq.operators import prediction_metrics as PM
from fieldseq.operators.results import declined, model_totals


@pytest.mark.parametrize("n", [1, 2, 37, 3000])
def test_quantiles_equal_numpy(spark, n):
    values = np.round(np.random.default_rng(n).normal(size=n), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = order_stats.linear_quantiles(df, "v", shares).first()[0]
    assert np.allclose(got, np.quantile(values, shares), atol=1e-12)


def test_cumulative_with_a_hot_value(spark):
    values = [0.5] * 1000 + [0.1, 0.2, 0.9]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.5)], "g string, v double")
    got = {(r.g, r.v): (r.n, r.before, r.total)
           for r in order_stats.cumulative(df, "v", ["g"]).collect()}
    assert got == {("a", 0.1): (1, 0, 1003), ("a", 0.2): (1, 1, 1003), ("a", 0.5): (1000, 2, 1003),
                   ("a", 0.9): (1, 1002, 1003), ("b", 0.5): (1, 0, 1)}


def test_losses_and_auc(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.3).astype(int)
    p = np.round(np.clip(0.3 + 0.3 * (y - 0.3) + rng.normal(0, .2, 500), 0, 1), 2)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p, strict=True)],
                               "model string, y int, p double")
    got = PM.report(df).first()
    c = np.clip(p, 1e-6, 1 - 1e-6)
    assert got.log_loss == pytest.approx(-np.mean(y * np.log(c) + (1 - y) * np.log(1 - c)))
    assert got.brier == pytest.approx(np.mean((c - y) ** 2))
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert got.auc == pytest.approx(auc)


def test_gap_is_undefined_without_a_better_reference(spark):
    loss = spark.createDataFrame([("b", 0.2), ("m", 0.1), ("r", 0.3)], "model string, log_loss double")
    assert PM.gap_closed(loss, "b", "m", "r").first()[0] is None
    assert PM.gap_closed(loss, "r", "b", "m").first()[0] == pytest.approx(0.5)


def test_declined_shots_are_null_not_zero(spark):
    df = spark.createDataFrame([(1, 1, "Penalty", 11.0, 0.3, None), (1, 2, "Open Play", 9.0, 0.4, 0.2)],
                               "match_id int, possession int, shot_type string, distance double, "
                               "angle double, my_xg double")
    why = [r[0] for r in df.select(declined(*[F.col(c) for c in ("shot_type", "distance", "angle")]))
           .collect()]
    assert why == ["penalty, not modelled", None]
    totals = {r.possession: r.my_xg_sum for r in model_totals(df).collect()}
    assert totals == {1: None, 2: 0.2}


@pytest.fixture(scope="module")
def shots(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        d, a = float(rng.uniform(5, 40)), float(rng.uniform(0.05, 1.2))
        far = float(rng.uniform(0, 5)) if i % 9 else None
        p = 1 / (1 + np.exp(0.13 * d - 1.5 * a + (0 if far is None else 0.3 * far)))
        rows.append((f"e{i}", i % 6, 1, "Penalty" if i % 50 == 0 else "Open Play",
                     bool(rng.random() < p), float(p), d, a, None if far is None else int(far), far,
                     far, far, "Foot" if i % 3 else "Head", "Normal", "Regular Play", None, i % 4 == 0))
    return spark.createDataFrame(rows, (
        "event_id string, competition_id int, season_id int, shot_type string, is_goal boolean, "
        "provider_xg double, distance double, angle double, n_def_in_cone int, "
        "dist_nearest_def double, gk_dist_to_goal double, gk_off_line double, body_part string, "
        "technique string, play_pattern string, first_time boolean, under_pressure boolean")).cache()


def test_rows_split_and_guards(spark, shots):
    rows = xg.modelling_rows(shots)
    assert rows.count() == 1470 and rows.filter("first_time <> 0").count() == 0
    train, test = xg.split(rows, ["5:1"])
    assert xg.shared_groups(train, test).count() == 0
    assert xg.shared_groups(rows, test).count() == 1
    with pytest.raises(ValueError, match="provider_xg"):
        xg.checked_features(["distance", "provider_xg"])
    folds = xg.with_folds(train, 5).groupBy("group").agg(F.count_distinct("fold").alias("n"))
    assert folds.filter("n > 1").count() == 0


def test_fit_predict_save(spark, shots, tmp_path):
    train, test = xg.split(xg.modelling_rows(shots), ["5:1"])
    baseline = xg.fit_baseline(train)
    model = xg.fit_ensemble(train, "sigmoid", xg.settings_for(8))
    table = xg.prediction_table(test, baseline, model)
    rows = PM.long_form(table, {"base": "p_base", "mine": "p_mine"})
    report = {r.model: r for r in PM.report(rows).collect()}
    rate = train.agg(F.avg("is_goal")).first()[0]
    y = np.array([r.is_goal for r in test.collect()])
    constant = -np.mean(y * np.log(rate) + (1 - y) * np.log(1 - rate))
    assert report["base"].log_loss < constant and report["mine"].log_loss < constant
    assert report["mine"].auc > 0.6

    model.save(str(tmp_path / "m"))
    again = xg.Ensemble.load(spark, str(tmp_path / "m"))
    both = model.predict(test, "a").join(again.predict(test, "b").select("event_id", "b"), "event_id")
    assert PM.largest_difference(both, "a", "b").first()[0] < 1e-12
    scored = xg.score_shots(shots, again)
    assert scored.filter("shot_type = 'Penalty' and my_xg is not null").count() == 0
    assert scored.filter("shot_type <> 'Penalty' and my_xg is null").count() == 0


def test_close_beats_far_and_unknown_levels_are_safe(spark, shots):
    train, _ = xg.split(xg.modelling_rows(shots), ["5:1"])
    model = xg.fit_ensemble(train, "sigmoid", xg.settings_for(8))
    cols = train.columns
    base = train.limit(1).collect()[0].asDict()
    cases = [dict(base, event_id="close", distance=6.0, angle=1.0),
             dict(base, event_id="far", distance=32.0, angle=0.15),
             dict(base, event_id="odd", body_part="Elbow", distance=6.0, angle=1.0)]
    df = spark.createDataFrame([tuple(c[k] for k in cols) for c in cases], train.schema)
    p = {r.event_id: r.p_mine for r in model.predict(df).collect()}
    assert p["close"] > p["far"] and 0 < p["odd"] < 1
    table = xg.importances(spark, model.members[0][0]).collect()
    assert table[0].importance >= table[-1].importance


def test_calibrators(spark, shots):
    train = xg.modelling_rows(shots).withColumn("margin", -F.col("distance") / 10)
    for method in ("raw", "isotonic", "sigmoid"):
        c = xg.fit_calibrator(train, method)
        scored = train.select("margin", c.apply(F.col("margin")).alias("p")).orderBy("margin").collect()
        ps = [r.p for r in scored]
        assert all(0 <= p <= 1 for p in ps) and all(b >= a - 1e-12 for a, b in zip(ps, ps[1:]))


def test_method_choice(spark, shots):
    train, _ = xg.split(xg.modelling_rows(shots), ["5:1"])
    losses = xg.choose_method(train, xg.settings_for(2), folds=2, methods=("raw", "sigmoid"))
    assert set(losses) == {"raw", "sigmoid"} and list(losses.values()) == sorted(losses.values())
