"""Queries on modelling rows, prediction quality and model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldseq.operators import folds, isotonic, portable
from fieldseq.operators import prediction_metrics as PM
from fieldseq.operators import xg
from fieldseq.plans.base import cte, query, r6, shots, with_sql
from fieldseq.sources.tables import written

TEST_GROUPS = ("1:0", "2:1")
_TEST = "('1:0', '2:1')"

cte("mrows", """select *, concat(competition_id, ':', season_id) as grp from shots
    where shot_type <> 'Penalty' and distance is not null and angle is not null""", ("shots",))
# Fixed formulas of distance and angle in place of trained models, so both
# engines score alike. The first is rounded coarsely to give equal scores, the second
# finely, as the last digit of exp() differs between math libraries.
cte("preds", """select event_id, grp, is_goal::int as y,
    round(1 / (1 + exp(0.5::double + 0.03::double * distance)), 2) as p_base,
    round(1 / (1 + exp(0.9::double + 0.045::double * distance - 1.1::double * angle)), 9) as p_mine,
    provider_xg as p_ref from mrows""", ("mrows",))
cte("plong", """select event_id, grp, y, 'baseline' as model, p_base as p from preds
    union all select event_id, grp, y, 'mine', p_mine from preds
    union all select event_id, grp, y, 'reference', p_ref from preds""", ("preds",))
cte("ploss", """select model, count(*) as n,
    avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p)))))
      as log_loss,
    avg(pow(greatest(1e-6, least(1 - 1e-6, p)) - y, 2)) as brier,
    sum(greatest(1e-6, least(1 - 1e-6, p))) as expected, sum(y)::bigint as observed
  from plong group by model""", ("plong",))

MODELS = {"baseline": "p_base", "mine": "p_mine", "reference": "p_ref"}


def model_rows(spark, sf_dir):
    return xg.modelling_rows(shots(spark, sf_dir))


def formula_predictions(spark, sf_dir):
    d, a = F.col("distance"), F.col("angle")
    rows = model_rows(spark, sf_dir)
    return rows.select(
        "event_id", "group", "is_goal",
        F.round(1 / (1 + F.exp(0.5 + 0.03 * d)), 2).alias("p_base"),
        F.round(1 / (1 + F.exp(0.9 + 0.045 * d - 1.1 * a)), 9).alias("p_mine"),
        F.col("provider_xg").alias("p_ref"))


def long_predictions(spark, sf_dir):
    return PM.long_form(formula_predictions(spark, sf_dir), MODELS, keep=["group"])


@query("modelling_rows", with_sql(("mrows",), """
select event_id, grp as "group", is_goal::int as is_goal, round(distance, 6) as distance,
  n_def_in_cone::double as n_def_in_cone, first_time::int as first_time, body_part from mrows"""))
def modelling_rows(spark, sf_dir):
    return model_rows(spark, sf_dir).select(
        "event_id", "group", "is_goal", r6("distance").alias("distance"), "n_def_in_cone",
        "first_time", "body_part")


@query("split_statistics", with_sql(("mrows",), f"""
select case when grp in {_TEST} then 'test' else 'train' end as split, count(*) as n,
  count(distinct grp) as n_groups, round(avg(is_goal::int), 6) as goal_rate from mrows group by 1"""))
def split_statistics(spark, sf_dir):
    s = xg.split_statistics(model_rows(spark, sf_dir), TEST_GROUPS)
    return s.withColumn("goal_rate", r6("goal_rate"))


@query("split_leaks", with_sql(("mrows",), f"""
select grp as "group" from mrows where grp in {_TEST} intersect
select grp from mrows where grp not in {_TEST}"""))
def split_leaks(spark, sf_dir):
    return xg.shared_groups(*xg.split(model_rows(spark, sf_dir), TEST_GROUPS))


@query("xg_metrics", with_sql(("ploss",), """
select model, n, round(log_loss, 6) as log_loss, round(brier, 6) as brier,
  round(expected, 6) as expected, observed, round(observed / expected, 6) as oe_ratio from ploss"""))
def xg_metrics(spark, sf_dir):
    m = PM.losses(long_predictions(spark, sf_dir))
    return m.select("model", "n", r6("log_loss").alias("log_loss"), r6("brier").alias("brier"),
                    r6("expected").alias("expected"), "observed", r6("oe_ratio").alias("oe_ratio"))


@query("xg_auc", with_sql(("plong",), """
select model, round((sum(mid) filter (where y = 1) - count(*) filter (where y = 1)
    * (count(*) filter (where y = 1) + 1) / 2.0::double)
  / (count(*) filter (where y = 1) * count(*) filter (where y = 0))::double, 6) as auc
from (select model, y, rank() over (partition by model order by p)
        + (count(*) over (partition by model, p) - 1) / 2.0::double as mid from plong)
group by model"""))
def xg_auc(spark, sf_dir):
    return PM.auc(long_predictions(spark, sf_dir)).withColumn("auc", r6("auc"))


@query("xg_metrics_by_group", with_sql(("plong",), """
select "group", model, n, round(log_loss, 6) as log_loss, observed from (
  select grp as "group", model, count(*) as n, sum(y)::bigint as observed,
    avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y)
      * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))) as log_loss
  from plong group by grp, model)"""))
def xg_metrics_by_group(spark, sf_dir):
    m = PM.losses(long_predictions(spark, sf_dir), ["group", "model"])
    return m.select("group", "model", "n", r6("log_loss").alias("log_loss"), "observed")


@query("gap_closed", with_sql(("ploss",), """
select round(case when b > r then (b - m) / (b - r) end, 6) as gap_closed from (
  select max(log_loss) filter (where model = 'baseline') as b,
    max(log_loss) filter (where model = 'mine') as m,
    max(log_loss) filter (where model = 'reference') as r from ploss)"""))
def gap_closed(spark, sf_dir):
    g = PM.gap_closed(PM.losses(long_predictions(spark, sf_dir)), "baseline", "mine", "reference")
    return g.select(r6("gap_closed").alias("gap_closed"))


_SHARES = "[" + ", ".join(f"{i / 10}::double" for i in range(11)) + "]"


@query("calibration_bins", with_sql(("plong",), f"""
select model, bin, n, round(mean_p, 6) as mean_p, round(rate, 6) as rate from (
  select model, bin, count(*) as n, avg(p) as mean_p, avg(y) as rate from (
    select l.model, l.p, l.y, len(list_filter(e.edges[2:-2], lambda v: v <= l.p))::int as bin
    from plong l join (select model, list_sort(list_distinct(quantile_cont(p, {_SHARES}))) as edges
      from plong group by model) e using (model)) group by model, bin) where n >= 20"""))
def calibration_bins(spark, sf_dir):
    c = PM.calibration(long_predictions(spark, sf_dir))
    return c.select("model", "bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query("score_histogram", with_sql(("plong",), """
select model, bin, count(*) as n from (
  select model, least(39, floor((p - lo) * 40 / (hi - lo)))::int as bin
  from plong join (select model, min(p) as lo, max(p) as hi from plong group by model) using (model))
group by model, bin"""))
def score_histogram(spark, sf_dir):
    return PM.histogram(long_predictions(spark, sf_dir))


@query("score_difference", with_sql(("preds",), """
select round(max(abs(p_base - p_mine)), 6) as max_abs_diff from preds"""))
def score_difference(spark, sf_dir):
    d = PM.largest_difference(formula_predictions(spark, sf_dir), "p_base", "p_mine")
    return d.select(r6("max_abs_diff").alias("max_abs_diff"))


cte("fold_groups", """select *, row_number() over (order by n desc, match_id) as o
    from (select match_id, count(*) as n from mrows group by match_id)""", ("mrows",))


@query("fold_sizes", "with recursive " + with_sql(("fold_groups",), """
, deal as (
    select 0::bigint as o, null::bigint as match_id, 0::bigint as n, null::int as fold, [0, 0, 0, 0, 0]::bigint[] as loads
    union all
    select g.o, g.match_id, g.n, list_position(loads, list_min(loads))::int - 1,
      list_transform(loads, lambda v, i: v + case when i = list_position(loads, list_min(loads)) then g.n else 0 end)
    from deal d join fold_groups g on g.o = d.o + 1)
select match_id, n, fold from deal where o > 0""").removeprefix("with "))
def fold_sizes(spark, sf_dir):
    """Matches dealt to five folds, the one with most shots first, each to the lightest fold."""
    rows = shots(spark, sf_dir).join(model_rows(spark, sf_dir).select("event_id"), "event_id")
    return folds.group_folds(rows, 5, "match_id")


@query("isotonic_steps", with_sql(("preds",), """
, c as (select p_base as m, count(*)::double as n, sum(y)::double as s, row_number() over (order by p_base) as i
        from preds group by p_base),
  t as (select a.i as a, b.i as b, sum(c.s) / sum(c.n) as mean from c a join c b on a.i <= b.i
        join c on c.i between a.i and b.i group by a.i, b.i),
  low as (select k.i, a, min(mean) as low from c k join t on t.a <= k.i and t.b >= k.i group by k.i, a)
select m as margin, round(max(low), 6) as value from low join c using (i) group by m"""))
def isotonic_steps(spark, sf_dir):
    """Rising goal rates over the coarse baseline score, looked up for each distinct score."""
    scored = formula_predictions(spark, sf_dir).select("event_id", "is_goal", F.col("p_base").alias("margin"))
    steps = written(isotonic.fit_steps(scored), "steps")
    found = isotonic.calibrated(scored, steps, "margin", "value", "event_id")
    return found.select("margin", r6("value").alias("value")).distinct()


@query("method_choice")
def method_choice(spark, sf_dir):
    """Out-of-fold loss of each calibration method, three balanced folds of whole groups; three
    rounds instead of 300, as 21 ensemble members are fitted."""
    train, _ = xg.split(model_rows(spark, sf_dir), TEST_GROUPS)
    losses = xg.choose_method(written(train, "train"), xg.settings_for(3), folds=3)
    rows = [(method, loss, i == 0) for i, (method, loss) in enumerate(losses.items())]
    return spark.createDataFrame(rows, "method string, log_loss double, chosen boolean")


@query("portable_audit", with_sql(("mrows",), """
select count(*) as n, true as equal from mrows"""))
def portable_audit(spark, sf_dir):
    """All modelled shots scored by the fitted ensemble and from its node tables."""
    rows = written(model_rows(spark, sf_dir), "rows")
    fitted = xg.fit_ensemble(rows, "sigmoid", xg.settings_for(10))
    gap = portable.largest_gap(fitted, portable.export(spark, fitted), rows)
    return gap.select("n", (F.col("gap") < 1e-9).alias("equal"))


@query("xg_baseline_fit")
def xg_baseline_fit(spark, sf_dir):
    """Trained baseline's probabilities for the held-out groups. Fitting reads its rows several times."""
    train, test = xg.split(written(model_rows(spark, sf_dir), "rows"), TEST_GROUPS)
    return xg.predict_baseline(xg.fit_baseline(train), test).select(
        "event_id", "group", "is_goal", "p_base")


@query("xg_ensemble_fit")
def xg_ensemble_fit(spark, sf_dir):
    """Prediction table of a calibrated tree ensemble, fitted with the default settings."""
    train, test = xg.split(written(model_rows(spark, sf_dir), "rows"), TEST_GROUPS)
    mine = xg.fit_ensemble(train, "sigmoid")
    return xg.prediction_table(test, xg.fit_baseline(train), mine)
