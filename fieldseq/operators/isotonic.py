"""Isotonic calibration whose steps are a table.

Equal scores are counted together. Neighbouring scores lie in the same range; each range
pools its violators, then neighbouring ranges are merged and pooled again, up a tree.
Labels are 0 or 1, and steps have different rates: of n rows there can be no more steps
than fractions whose denominators sum to n, about n to the power of 2/3, so the last merge
is small. Scores are looked up by an as-of join, in ranges as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseq.operators.skew import spread_join, stacked
from fieldseq.sources.tables import written

_BLOCK = "lo double, hi double, n long, s long"
#: Ranges merged at a time.
FAN = 16


def push(held: list[tuple], block: tuple[float, float, int, int]) -> None:
    """Append a block (lo, hi, rows, positives), pooling violators: rates rise strictly."""
    lo, hi, n, s = block
    while held and held[-1][3] * n >= s * held[-1][2]:
        lo, _, m, t = held.pop()
        n, s = n + m, s + t
    held.append((lo, hi, n, s))


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    part = None
    for batch in batches:
        for r in batch.itertuples(index=False):
            part = r.part
            push(held, (r.lo, r.hi, int(r.n), int(r.s)))
    if held:
        yield pd.DataFrame(held, columns=["lo", "hi", "n", "s"]).assign(part=part)


def fit_steps(scored: DataFrame, score: str = "margin", label: str = "is_goal", fan: int = FAN) -> DataFrame:
    """(lo, hi, n, value, next_lo, next_value): rising rates of a 0/1 label over ranges of scores.

    Null and NaN scores and null labels take no part. Blocks of equal rate are one step.
    """
    known = scored.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    counted = known.groupBy(F.col(score).cast("double").alias("lo")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("s"))
    ranged = (counted.select("lo", F.col("lo").alias("hi"), "n", "s").repartitionByRange("lo")
              .sortWithinPartitions("lo").withColumn("part", F.spark_partition_id()))
    level = written(ranged.mapInPandas(_pool, f"{_BLOCK}, part int"), "pooled")
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held: list[tuple] = []
        for r in rows.sort_values("lo").itertuples(index=False):
            push(held, (r.lo, r.hi, int(r.n), int(r.s)))
        return pd.DataFrame(held, columns=["lo", "hi", "n", "s"]).assign(part=key[0])

    while parts > 1:
        level = written(level.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part")
                        .applyInPandas(merge, f"{_BLOCK}, part int"), "pooled")
        parts = -(-parts // fan)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo").assign(value=lambda r: r.s / r.n)
        return rows.assign(next_lo=rows.lo.shift(-1), next_value=rows.value.shift(-1))[
            ["lo", "hi", "n", "value", "next_lo", "next_value"]]
    return level.groupBy("part").applyInPandas(
        finish, "lo double, hi double, n long, value double, next_lo double, next_value double")


def as_of(points: DataFrame, steps: DataFrame, at: str, start: str, carried: Column) -> DataFrame:
    """(at, found): for each distinct point, `carried` of the last step that starts at or before it.

    Points and steps are cut into ranges together; the last step of a range is carried over
    to those after it, which takes one row per range.
    """
    both = stacked([points.select(F.col(at).cast("double").alias("_at")).distinct()
                    .select("_at", F.lit(1).alias("_kind"), F.lit(None).cast(steps.select(carried.alias("c")).schema["c"].dataType).alias("_step")),
                    steps.select(F.col(start).cast("double").alias("_at"), F.lit(0).alias("_kind"), carried.alias("_step"))])
    ranged = written(both.repartitionByRange("_at", "_kind").withColumn("_range", F.spark_partition_id()), "as_of")
    last = F.max_by("_step", F.when(F.col("_kind") == 0, F.col("_at")))
    ends = ranged.groupBy("_range").agg(last.alias("_last"))
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_range", F.last("_last", ignorenulls=True).over(over).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (ranged.withColumn("_own", F.last("_step", ignorenulls=True).over(inside)).join(ends, "_range")
             .filter("_kind = 1"))
    return found.select(F.col("_at").alias(at), F.coalesce("_own", "_before").alias("found"))


def calibrated(rows: DataFrame, steps: DataFrame, score: str, out: str, seed: str) -> DataFrame:
    """Add the step value of each score; between two steps it rises in a straight line.

    Scores before the first step have its value, null and NaN scores none. `seed` names a
    column whose hash spreads rows of one score over tasks.
    """
    step = F.struct("hi", "value", "next_lo", "next_value")
    known = rows.filter(F.col(score).isNotNull() & ~F.isnan(score))
    found = as_of(known, steps, score, "lo", step)
    first = steps.agg(F.min_by("value", "lo")).first()[0]
    s, m = F.col("found"), F.col(score)
    rise = (s["next_value"] - s["value"]) * (m - s["hi"]) / (s["next_lo"] - s["hi"])
    value = (F.when(s.isNull(), F.lit(first)).when((m <= s["hi"]) | s["next_lo"].isNull(), s["value"])
             .otherwise(s["value"] + rise))
    values = found.select(F.col(score).alias("_score"), value.alias(out))
    keyed = rows.withColumn("_score", F.col(score).cast("double"))
    return spread_join(keyed, values, ["_score"], F.col(seed), "left").drop("_score")
