"""Expected-goals modelling: rows, split, baseline, boosted trees, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.operators import isotonic
from fieldseq.operators.folds import group_folds
from fieldseq.operators.prediction_metrics import clipped, logistic
from fieldseq.operators.results import PENALTY
from fieldseq.operators.skew import spread_join, stacked
from fieldseq.sources.tables import written

NUMERIC = ("distance", "angle")
CONTEXT = ("n_def_in_cone", "dist_nearest_def", "gk_dist_to_goal", "gk_off_line")
CATEGORICAL = ("body_part", "technique", "shot_type", "play_pattern")
BOOLEAN = ("first_time", "under_pressure")
# Columns that give the answer away.
FORBIDDEN = ("is_goal", "provider_xg", "label", "value")
MISSING = -1.0
# Isotonic steps that may be written into an expression.
LITERAL_STEPS = 200


@dataclass(frozen=True)
class TreeSettings:
    """Defaults: many small steps of shallow trees on most rows and features."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 4
    min_rows: int = 60
    row_share: float = 0.9
    feature_share: str = "0.9"
    seed: int = 42


def modelling_rows(shots: DataFrame) -> DataFrame:
    """Shots fit for modelling, with group key, numeric features and 0/1 label."""
    kept = shots.filter((F.col("shot_type") != PENALTY) & F.col("distance").isNotNull()
                        & F.col("angle").isNotNull())
    numbers = [F.col(c).cast("double").alias(c) for c in (*NUMERIC, *CONTEXT)]
    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in BOOLEAN]
    words = [F.coalesce(c, F.lit("")).alias(c) for c in CATEGORICAL]
    return kept.select(
        "event_id", group_key(F.col("competition_id"), F.col("season_id")).alias("group"),
        F.col("is_goal").cast("int").alias("is_goal"),
        F.col("provider_xg").cast("double").alias("provider_xg"), *numbers, *flags, *words)


def group_key(competition_id: Column, season_id: Column) -> Column:
    return F.concat_ws(":", competition_id.cast("string"), season_id.cast("string"))


def split(rows: DataFrame, test_groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    held = F.col("group").isin(*test_groups)
    return rows.filter(~held), rows.filter(held)


def shared_groups(train: DataFrame, test: DataFrame) -> DataFrame:
    """Groups on both sides of a split; any row is a leak."""
    return train.select("group").intersect(test.select("group"))


def split_statistics(rows: DataFrame, test_groups: Sequence[str]) -> DataFrame:
    side = F.when(F.col("group").isin(*test_groups), "test").otherwise("train")
    return rows.groupBy(side.alias("split")).agg(
        F.count("*").alias("n"), F.count_distinct("group").alias("n_groups"),
        F.avg("is_goal").alias("goal_rate"))


def checked_features(columns: Sequence[str]) -> list[str]:
    leaked = sorted(set(columns) & set(FORBIDDEN))
    if leaked:
        raise ValueError(f"label or reference columns among the features: {leaked}")
    return list(columns)


def _with_missing(rows: DataFrame) -> DataFrame:
    """Missing context becomes a marker plus an indicator; nothing is imputed."""
    return rows.withColumns({
        **{f"{c}_missing": F.col(c).isNull().cast("int") for c in CONTEXT},
        **{f"{c}_f": F.coalesce(c, F.lit(MISSING)) for c in CONTEXT},
        "label": F.col("is_goal").cast("double")})


def feature_columns() -> list[str]:
    return checked_features([*NUMERIC, *[f"{c}_f" for c in CONTEXT],
                             *[f"{c}_missing" for c in CONTEXT], *BOOLEAN,
                             *[f"{c}_ix" for c in CATEGORICAL]])


def _feature_stages() -> list:
    """Levels are learnt from the training rows; unseen ones share one code."""
    index = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_ix" for c in CATEGORICAL],
                          handleInvalid="keep", stringOrderType="alphabetAsc")
    return [index, VectorAssembler(inputCols=feature_columns(), outputCol="features")]


def fit_baseline(train: DataFrame) -> PipelineModel:
    """Logistic regression on standardised distance and angle, unit ridge penalty."""
    n = max(1, train.count())
    stages = [VectorAssembler(inputCols=checked_features(NUMERIC), outputCol="raw_features"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True,
                             withStd=True),
              LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / n,
                                 elasticNetParam=0.0, standardization=False, maxIter=1000)]
    return Pipeline(stages=stages).fit(_with_missing(train))


def predict_baseline(model: PipelineModel, rows: DataFrame, out: str = "p_base") -> DataFrame:
    scored = model.transform(_with_missing(rows))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias(out))


def fit_trees(train: DataFrame, settings: TreeSettings = TreeSettings()) -> PipelineModel:
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=settings.rounds,
        stepSize=settings.step, maxDepth=settings.depth, minInstancesPerNode=settings.min_rows,
        subsamplingRate=settings.row_share, featureSubsetStrategy=settings.feature_share,
        seed=settings.seed, maxBins=64)
    return Pipeline(stages=[*_feature_stages(), trees]).fit(_with_missing(train))


def margins(model: PipelineModel, rows: DataFrame, out: str = "margin") -> DataFrame:
    """Raw score of the trees, which is what calibrators are fitted on."""
    scored = model.transform(_with_missing(rows))
    return scored.select(*rows.columns, vector_to_array("rawPrediction")[1].alias(out))


def with_folds(rows: DataFrame, k: int, by: str | None = "group", seed: int = 42) -> DataFrame:
    """Fold number per row: whole groups, the largest to the lightest fold, or by hash."""
    if by is None:
        return rows.withColumn("fold", F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(k)))
    return spread_join(rows, group_folds(rows, k, by).select(by, "fold"), [by], F.col("event_id"))


@dataclass(frozen=True)
class Calibrator:
    """Maps a margin to a probability: `raw`, `sigmoid` (a, b) or `isotonic`.

    Isotonic steps are a table (`isotonic.fit_steps`); `apply` is for a few of them only.
    """

    method: str
    a: float = -2.0
    b: float = 0.0
    steps: DataFrame | None = None

    def calibrate(self, rows: DataFrame, margin: str, out: str) -> DataFrame:
        """Rows with the probability of their margin; steps are joined, never part of the plan."""
        if self.method == "isotonic":
            return isotonic.calibrated(rows, self.steps, margin, out, "event_id")
        return rows.withColumn(out, logistic(F.lit(self.a), F.lit(self.b), F.col(margin)))

    def apply(self, margin: Column) -> Column:
        if self.method != "isotonic":
            return logistic(F.lit(self.a), F.lit(self.b), margin)
        rows = self.steps.orderBy("lo").limit(LITERAL_STEPS + 1).collect()
        if len(rows) > LITERAL_STEPS:
            raise ValueError(f"more than {LITERAL_STEPS} steps: use calibrate")
        out = F.lit(rows[0].value)
        for r in rows:
            rise = (F.lit(0.0) if r.next_lo is None else
                    (r.next_value - r.value) * (margin - r.hi) / (r.next_lo - r.hi))
            out = F.when(margin >= r.lo, F.when(margin <= r.hi, F.lit(r.value)).otherwise(r.value + rise)).otherwise(out)
        return out


def fit_calibrator(scored: DataFrame, method: str) -> Calibrator:
    """Fit on (margin, is_goal). The plain link of Spark's trees is 1/(1+exp(-2 margin))."""
    if method == "raw":
        return Calibrator("raw")
    if method == "isotonic":
        return Calibrator("isotonic", steps=written(isotonic.fit_steps(scored), "steps"))
    counts = scored.agg(F.sum("is_goal").alias("p"), F.count("*").alias("n")).first()
    pos, neg = counts["p"] or 0, counts["n"] - (counts["p"] or 0)
    # Smoothed targets, each example standing for a weighted positive and negative.
    target = F.when(F.col("is_goal") == 1, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    halves = F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight")),
                     F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight")))
    weighted = scored.select("margin", F.explode(halves).alias("h")).select("margin", "h.*")
    weighted = VectorAssembler(inputCols=["margin"], outputCol="features").transform(weighted)
    model = LogisticRegression(weightCol="weight", standardization=True).fit(weighted)
    return Calibrator("sigmoid", a=-float(model.coefficients[0]), b=-float(model.intercept))


@dataclass(frozen=True)
class Ensemble:
    """Mean of calibrated members."""

    members: tuple[tuple[PipelineModel, Calibrator], ...]
    method: str

    def predict(self, rows: DataFrame, out: str = "p_mine") -> DataFrame:
        scored = rows
        names = []
        for i, (model, _) in enumerate(self.members):
            names.append(f"_margin{i}")
            scored = margins(model, scored, names[-1])
        total = F.lit(0.0)
        for name, (_, calibrator) in zip(names, self.members, strict=True):
            scored = calibrator.calibrate(scored, name, f"{name}_p")
            total = total + F.col(f"{name}_p")
        return scored.withColumn(out, total / len(self.members)).drop(*names, *[f"{n}_p" for n in names])

    def save(self, path: str) -> None:
        """Models in Spark's own format, calibrators as one small JSON table, steps as tables."""
        rows = []
        for i, (model, c) in enumerate(self.members):
            model.write().overwrite().save(f"{path}/member{i}")
            rows.append((i, c.method, c.a, c.b))
            if c.steps is not None:
                c.steps.write.mode("overwrite").parquet(f"{path}/steps{i}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "i int, method string, a double, b double") \
            .coalesce(1).write.mode("overwrite").json(f"{path}/calibrators")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        rows = spark.read.json(f"{path}/calibrators").orderBy("i").collect()
        return Ensemble(tuple(
            (PipelineModel.load(f"{path}/member{r['i']}"),
             Calibrator(r["method"], r["a"], r["b"], spark.read.parquet(f"{path}/steps{r['i']}")
                        if r["method"] == "isotonic" else None))
            for r in rows), rows[0]["method"])


def fit_ensemble(train: DataFrame, method: str, settings: TreeSettings = TreeSettings(),
                 members: int = 3) -> Ensemble:
    """Each member learns on all folds but one and is calibrated on that one.

    Members are fitted side by side: a level of a tree is one short job, and those of another
    member fill the tasks it leaves idle.
    """
    if method == "raw":
        return Ensemble(((fit_trees(train, settings), Calibrator("raw")),), method)
    folded = written(with_folds(train, members, by=None, seed=settings.seed), "members")

    def fit(i: int) -> tuple[PipelineModel, Calibrator]:
        model = fit_trees(folded.filter(F.col("fold") != i), settings)
        held = margins(model, folded.filter(F.col("fold") == i))
        return model, fit_calibrator(held, method)

    with ThreadPool(members) as pool:
        fitted = pool.map(inheritable_thread_target(train.sparkSession)(fit), range(members), chunksize=1)
    return Ensemble(tuple(fitted), method)


def out_of_fold(train: DataFrame, method: str, settings: TreeSettings = TreeSettings(),
                folds: int = 5) -> DataFrame:
    """Predictions for every training row by a model that never saw its group."""
    folded = written(with_folds(train, folds), "folds")
    parts = []
    for i in range(folds):
        model = fit_ensemble(folded.filter(F.col("fold") != i).drop("fold"), method, settings)
        parts.append(model.predict(folded.filter(F.col("fold") == i), "p"))
    return stacked(parts)


def choose_method(train: DataFrame, settings: TreeSettings = TreeSettings(), folds: int = 5,
                  methods: Sequence[str] = ("raw", "isotonic", "sigmoid")) -> dict[str, float]:
    """Out-of-fold log loss of each calibration method, best first."""
    losses = {}
    for method in methods:
        p, y = clipped(F.col("p")), F.col("is_goal")
        oof = out_of_fold(train, method, settings, folds)
        losses[method] = oof.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).first()[0]
    return dict(sorted(losses.items(), key=lambda item: item[1]))


def prediction_table(test: DataFrame, baseline: PipelineModel, mine: Ensemble) -> DataFrame:
    scored = mine.predict(predict_baseline(baseline, test))
    return scored.select("event_id", "group", "is_goal", "p_base", "p_mine",
                         F.col("provider_xg").alias("p_ref"), "distance", "shot_type",
                         F.col("n_def_in_cone").isNotNull().alias("has_freeze_frame"))


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Feature importances of a tree model, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(feature_columns(), values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


def score_shots(shots: DataFrame, model: Ensemble, out: str = "my_xg") -> DataFrame:
    """All shots with a model value; those the model declines get null."""
    scored = model.predict(modelling_rows(shots)).select("event_id", F.col("p_mine").alias(out))
    return shots.join(scored, "event_id", "left")


def settings_for(rounds: int) -> TreeSettings:
    return replace(TreeSettings(), rounds=rounds)
