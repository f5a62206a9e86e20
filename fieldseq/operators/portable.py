"""Fitted tree ensembles as plain tables, and scoring from the tables alone.

Every node of every tree becomes a row. Scoring sends a row down all trees at once, one
level per join with the node table, whose size is set by rounds and depth and does not
grow with the data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.operators import xg
from fieldseq.operators.prediction_metrics import logistic
from fieldseq.operators.skew import stacked
from fieldseq.sources.tables import scratch_dir


def node_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, categories, lo, hi, value, weight) of fitted trees.

    `lo` and `hi` are the children, -1 at leaves. A row goes to `lo` when its feature is at
    most the threshold or, for a coded category, among `categories`.
    """
    path = f"{scratch_dir(spark)}/fieldseq-{uuid.uuid4().hex}/trees"
    model.stages[-1].write().overwrite().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_about", "weight").drop("_about")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    split, coded = F.col("split"), F.col("split.numCategories") >= 0
    return nodes.join(weights, "tree").select(
        "tree", F.col("id").alias("node"), split["featureIndex"].alias("feature"),
        F.when(~coded, F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1))).alias("threshold"),
        F.when(coded, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.col("leftChild").alias("lo"), F.col("rightChild").alias("hi"), F.col("prediction").alias("value"), "weight")


def level_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(column, level, code) of the coded categories, as learnt from the training rows."""
    rows = [(column, level, i) for column, levels in zip(xg.CATEGORICAL, model.stages[0].labelsArray)
            for i, level in enumerate(levels)]
    return spark.createDataFrame(rows, "column string, level string, code int")


def features(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """(event_id, features array<double>) in the order the trees know; unseen levels share a code."""
    codes: dict[str, dict[str, int]] = {c: {} for c in xg.CATEGORICAL}
    for r in levels.collect():
        codes[r["column"]][r["level"]] = r["code"]
    values = [F.col(c).cast("double") for c in xg.NUMERIC]
    values += [F.coalesce(F.col(c).cast("double"), F.lit(xg.MISSING)) for c in xg.CONTEXT]
    values += [F.col(c).isNull().cast("double") for c in xg.CONTEXT]
    values += [F.col(c).cast("double") for c in xg.BOOLEAN]
    for column, known in codes.items():
        code = F.lit(float(len(known)))
        for level, i in known.items():
            code = F.when(F.col(column) == level, float(i)).otherwise(code)
        values.append(code)
    return rows.select("event_id", F.array(*values).alias("features"))


def walk(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, margin): weighted sum of the leaves each row ends in."""
    shape = nodes.agg(F.max("tree").alias("trees"), F.count("*").alias("n")).first()
    at = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(shape.trees)))).withColumn("node", F.lit(0))
    steps = F.broadcast(nodes)
    inner = nodes.filter("lo >= 0")
    value = F.get(F.col("features"), F.col("feature"))
    left = F.coalesce(F.array_contains("categories", value), value <= F.col("threshold"))
    for _ in range(depth_of(inner)):
        at = at.join(steps, ["tree", "node"]).select("event_id", "features", "tree", F.when(
            F.col("lo") < 0, F.col("node")).when(left, F.col("lo")).otherwise(F.col("hi")).alias("node"))
    ends = at.join(steps, ["tree", "node"])
    return ends.groupBy("event_id").agg(F.sum(F.col("weight") * F.col("value")).alias("margin"))


def depth_of(inner: DataFrame) -> int:
    """Longest way down, from the inner nodes of all trees."""
    depth, level = 0, inner.filter("node = 0").select("tree", "lo", "hi")
    while level.limit(1).count():
        depth += 1
        below = level.select("tree", F.explode(F.array("lo", "hi")).alias("node"))
        level = inner.join(F.broadcast(below), ["tree", "node"]).select("tree", "lo", "hi")
    return depth


@dataclass(frozen=True)
class Exported:
    """An ensemble as tables: nodes and levels by member, and a calibrator row or step table each."""

    nodes: DataFrame
    levels: DataFrame
    calibrators: tuple[xg.Calibrator, ...]

    def score(self, rows: DataFrame, out: str = "p_portable") -> DataFrame:
        """(event_id, p) by walking the node tables and calibrating the margins."""
        parts = []
        for i, calibrator in enumerate(self.calibrators):
            levels = self.levels.filter(F.col("member") == i).drop("member")
            margin = walk(features(rows, levels), self.nodes.filter(F.col("member") == i).drop("member"))
            if calibrator.method == "isotonic":
                scored = calibrator.calibrate(margin, "margin", "p")
            else:
                scored = margin.withColumn("p", logistic(F.lit(calibrator.a), F.lit(calibrator.b), F.col("margin")))
            parts.append(scored.select("event_id", "p"))
        return stacked(parts).groupBy("event_id").agg(F.avg("p").alias(out))


def export(spark: SparkSession, ensemble: xg.Ensemble) -> Exported:
    nodes = [node_table(spark, model).withColumn("member", F.lit(i)) for i, (model, _) in enumerate(ensemble.members)]
    levels = [level_table(spark, model).withColumn("member", F.lit(i)) for i, (model, _) in enumerate(ensemble.members)]
    return Exported(stacked(nodes), stacked(levels), tuple(c for _, c in ensemble.members))


def largest_gap(ensemble: xg.Ensemble, exported: Exported, rows: DataFrame) -> DataFrame:
    """One row: shots scored by both ways, and the largest difference between them."""
    both = ensemble.predict(rows, "_own").select("event_id", "_own").join(exported.score(rows), "event_id")
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("_own") - F.col("p_portable"))).alias("gap"))
