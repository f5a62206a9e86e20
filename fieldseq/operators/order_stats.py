"""Exact ranks and order statistics without bringing all values to one task.

Equal values are counted together first. Distinct values are then cut into buckets, and
buckets that still hold more than a limit are cut again, in rounds, by approximate
quantiles of their own values. They are ranked inside their bucket and lifted by the
total of the buckets before. The result is exact; the cuts only decide how evenly the
work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseq.operators.skew import spread_join
from fieldseq.sources.tables import written

#: Most distinct values that are ranked in one task, and parts a larger bucket is cut into.
IN_BUCKET, CUT = 100_000, 64


def in_buckets(counted: DataFrame, value: str, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """Add `_bucket`: numbers that rise with the value, none with more than `limit` rows of a group.

    Each round cuts every larger bucket by 63 quantiles of its own distinct values, so a
    round divides sizes by about 64 whatever the values look like.
    """
    limit = IN_BUCKET if limit is None else limit
    rows = written(counted.withColumn("_bucket", F.lit(0).cast("long")), "counted")
    at = F.array(*[F.lit(i / CUT) for i in range(1, CUT)])
    while True:
        sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).groupBy("_bucket").agg(
            F.max("_n").alias("_n"))
        large = sizes.filter(F.col("_n") > limit).select("_bucket")
        if large.isEmpty():
            return rows
        large = written(large, "large_buckets")
        edges = (rows.join(F.broadcast(large), "_bucket").select("_bucket", value).distinct()
                 .groupBy("_bucket").agg(F.percentile_approx(value, at, F.lit(1000)).alias("_edges")))
        cut = spread_join(rows, written(edges, "edges"), ["_bucket"], F.col(value), "left")
        below = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))
        rows = written(cut.withColumn("_bucket", F.col("_bucket") * CUT + F.when(
            F.col("_edges").isNull(), 0).otherwise(below)).drop("_edges"), "buckets")


def cumulative(df: DataFrame, value: str, by: Sequence[str] = (),
               sums: dict[str, Column] | None = None, limit: int | None = None) -> DataFrame:
    """Distinct values with `n`, `before` (rows with a smaller value) and `total`.

    `sums` adds further sums per value, e.g. the number of positives.
    """
    by = list(by)
    df = df.filter(F.col(value).isNotNull())
    extra = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"), *extra)
    counted = in_buckets(counted, value, by, limit)
    per_bucket = counted.groupBy(*by, "_bucket").agg(F.sum("n").alias("_in_bucket"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(
        *by, "_bucket", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_in_bucket").over(whole).alias("total"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value) \
        .rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (ranked.join(per_bucket, [*by, "_bucket"])
            .withColumn("before", F.col("_offset") + F.col("_inside"))
            .drop("_bucket", "_offset", "_inside"))


def values_at(ranked: DataFrame, value: str, positions: dict[str, Column],
              by: Sequence[str] = ()) -> DataFrame:
    """Values at 0-based positions (columns over `total`) of a `cumulative` table."""
    picks = []
    for name, position in positions.items():
        here = (position >= F.col("before")) & (position < F.col("before") + F.col("n"))
        picks.append(F.max(F.when(here, F.col(value))).alias(name))
    return ranked.groupBy(*by).agg(*picks)


def linear_quantiles(df: DataFrame, value: str, shares: Sequence[float],
                     by: Sequence[str] = ()) -> DataFrame:
    """Per group an array `edges`: exact quantiles, interpolated linearly between neighbours."""
    ranked = cumulative(df, value, by)
    picks = [F.max("total").alias("total")]
    for i, q in enumerate(shares):
        spot = F.lit(q) * (F.col("total") - 1)
        for name, place in ((f"lo{i}", F.floor(spot)), (f"hi{i}", F.ceil(spot))):
            here = (place >= F.col("before")) & (place < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col(value))).alias(name))
    edges = []
    for i, q in enumerate(shares):
        spot = F.lit(q) * (F.col("total") - 1)
        edges.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}"))
                     * (spot - F.floor(spot)))
    return ranked.groupBy(*by).agg(*picks).select(*by, F.array(*edges).alias("edges"))
