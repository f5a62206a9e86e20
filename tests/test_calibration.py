"""Balanced folds, isotonic steps and node tables against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_model import shots  # noqa: F401

from fieldseq.operators import folds, isotonic, portable, xg


def dealt(sizes, k):
    """Largest group first, each to the lightest fold."""
    loads, out = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold = loads.index(min(loads))
        out[name] = fold
        loads[fold] += n
    return out


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 3), (3, 1), (4, 7)])
def test_folds_are_dealt_to_the_lightest(spark, seed, k):
    rnd = random.Random(seed)
    sizes = {f"g{i:03d}": rnd.choice([1, 1, 1, 2, 3, 5, 40]) for i in range(70)} | {"one big": 90}
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "group string, i int")
    got = {r.group: r.fold for r in folds.group_folds(rows, k).collect()}
    assert got == dealt(sizes, k)


def test_filled_equals_one_by_one():
    rnd = random.Random(9)
    for _ in range(300):
        loads = [rnd.randint(0, 30) for _ in range(rnd.randint(1, 6))]
        size, count = rnd.randint(1, 9), rnd.randint(0, 25)
        now, want = list(loads), [0] * len(loads)
        for _ in range(count):
            f = now.index(min(now))
            now[f] += size
            want[f] += 1
        assert folds.filled(loads, size, count) == want


def plain_isotonic(pairs):
    """Rates by the min-max formula over distinct scores."""
    xs = sorted({m for m, _ in pairs})
    n = np.array([sum(m == x for m, _ in pairs) for x in xs])
    s = np.array([sum(y for m, y in pairs if m == x) for x in xs])
    return xs, [max(min(s[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, len(xs))) for a in range(i + 1))
                for i in range(len(xs))]


@pytest.mark.parametrize("seed,n,digits", [(1, 300, 1), (2, 120, 3), (3, 1, 1), (4, 200, 2)])
def test_steps_against_the_min_max_formula(spark, seed, n, digits):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=n), digits)
    pairs = [(float(a), int(rng.random() < 1 / (1 + np.exp(-2 * a)))) for a in m]
    odd = [(None, 1), (float("nan"), 0), (0.1, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs + odd)], "event_id int, margin double, is_goal int").repartition(6)
    steps = isotonic.fit_steps(df, fan=2).cache()
    xs, values = plain_isotonic(pairs)
    asked = [(i, x) for i, x in enumerate([*xs, -99.0, 99.0, None, *[(a + b) / 2 for a, b in zip(xs, xs[1:])]])]
    rows = spark.createDataFrame(asked, "event_id int, margin double")
    got = {r.event_id: r.p for r in isotonic.calibrated(rows, steps, "margin", "p", "event_id").collect()}
    for i, x in asked:
        assert (got[i] is None) if x is None else got[i] == pytest.approx(float(np.interp(x, xs, values))), x
    kept = steps.orderBy("lo").collect()
    assert all(b.value > a.value for a, b in zip(kept, kept[1:])) and sum(r.n for r in kept) == n


def test_as_of_carries_over_empty_ranges(spark):
    steps = spark.createDataFrame([(0.0, "a"), (10.0, "b")], "lo double, name string")
    points = spark.createDataFrame([(float(x),) for x in range(-5, 200)], "x double").repartition(8)
    got = {r.x: r.found for r in isotonic.as_of(points, steps, "x", "lo", F.col("name")).collect()}
    assert got == {float(x): None if x < 0 else "a" if x < 10 else "b" for x in range(-5, 200)}


@pytest.mark.parametrize("method", ["raw", "sigmoid", "isotonic"])
def test_node_tables_score_as_the_ensemble(spark, shots, tmp_path, method):  # noqa: F811
    train, test = xg.split(xg.modelling_rows(shots), ["5:1"])
    model = xg.fit_ensemble(train, method, xg.settings_for(6), members=2)
    odd = test.limit(3).withColumns({"body_part": F.lit("Elbow"), "event_id": F.concat(F.lit("odd"), "event_id"),
                                     "gk_off_line": F.lit(None).cast("double")})
    rows = test.unionByName(odd)
    gap = portable.largest_gap(model, portable.export(spark, model), rows).first()
    assert gap.n == rows.count() and gap.gap < 1e-9
    model.save(str(tmp_path / "m"))
    again = xg.Ensemble.load(spark, str(tmp_path / "m"))
    gap = portable.largest_gap(again, portable.export(spark, model), test).first()
    assert gap.gap < 1e-9
