"""Quality of predicted probabilities: losses, AUC, calibration, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.operators import order_stats
from fieldseq.sources.tables import written

CLIP = 1e-6
CALIBRATION_BINS = 10
MIN_BIN_ROWS = 20
HISTOGRAM_BINS = 40


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))


def logistic(a: Column, b: Column, margin: Column) -> Column:
    """Calibrated probability of a raw margin."""
    return 1 / (1 + F.exp(a * margin + b))


def long_form(preds: DataFrame, models: Mapping[str, str], label: str = "is_goal",
              keep: Sequence[str] = ()) -> DataFrame:
    """(model, y, p) rows; `models` maps a model name to its probability column."""
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p"))
                        for m, c in models.items()])
    return (preds.select(*keep, F.col(label).cast("int").alias("y"), F.explode(entries).alias("e"))
            .select(*keep, "y", "e.model", "e.p"))


def losses(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Log loss, Brier score, expected and observed counts, and their ratio."""
    p, y = clipped(F.col("p")), F.col("y")
    return (rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"), F.sum(p).alias("expected"),
        F.sum(y).alias("observed"))
        .withColumn("oe_ratio", F.try_divide(F.col("observed"), F.col("expected"))))


def auc(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Area under the ROC curve by exact mid-ranks; equal scores count half."""
    ranked = order_stats.cumulative(rows, "p", by, {"pos": F.col("y")})
    mid = F.col("before") + (F.col("n") + 1) / 2
    sums = ranked.groupBy(*by).agg(F.sum(F.col("pos") * mid).alias("s"),
                                   F.sum("pos").cast("double").alias("a"),
                                   F.max("total").cast("double").alias("t"))
    a, rest = F.col("a"), F.col("t") - F.col("a")
    return sums.select(*by, F.try_divide(F.col("s") - a * (a + 1) / 2, a * rest).alias("auc"))


def report(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return losses(rows, by).join(auc(rows, by), list(by))


def gap_closed(loss: DataFrame, baseline: str, mine: str, reference: str) -> DataFrame:
    """Share of the baseline-to-reference log-loss gap a model closes; null when there is none."""
    def of(name: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col("log_loss")))
    one = loss.agg(of(baseline).alias("b"), of(mine).alias("m"), of(reference).alias("r"))
    gap = F.col("b") - F.col("r")
    return one.select(F.when(gap > 0, (F.col("b") - F.col("m")) / gap).alias("gap_closed"))


def calibration(rows: DataFrame, bins: int = CALIBRATION_BINS,
                min_rows: int = MIN_BIN_ROWS) -> DataFrame:
    """Mean prediction and observed rate in equal-count bins, per model.

    Edges are exact quantiles; equal edges are merged and small bins left out.
    """
    edges = order_stats.linear_quantiles(rows, "p", [i / bins for i in range(bins + 1)], ["model"])
    # Stored, so that Spark knows how small it is and may broadcast it.
    edges = written(edges.select("model", F.array_distinct("edges").alias("edges")), "edges")
    inner = F.slice("edges", F.lit(2), F.greatest(F.lit(0), F.size("edges") - 2))
    binned = rows.join(edges, "model").withColumn(
        "bin", F.size(F.filter(inner, lambda e: e <= F.col("p"))))
    return (binned.groupBy("model", "bin")
            .agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
            .filter(F.col("n") >= min_rows))


def histogram(rows: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins between each model's smallest and largest value.

    A model with a single value has all its rows in the middle bin.
    """
    ends = rows.groupBy("model").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor(F.try_divide(
        (F.col("p") - F.col("lo")) * bins, width)))).otherwise(bins // 2)
    return (rows.join(ends, "model").withColumn("bin", place.cast("int"))
            .groupBy("model", "bin").agg(F.count("*").alias("n")))


def largest_difference(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Largest absolute difference of two score columns."""
    return rows.agg(F.max(F.abs(F.col(left) - F.col(right))).alias("max_abs_diff"))
