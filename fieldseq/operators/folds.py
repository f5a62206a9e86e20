"""Group folds of balanced size: the largest group goes to the lightest fold.

Groups of one size are alike, so only the sizes and how often they occur matter for the
dealing; there are never more distinct sizes than the square root of twice the rows. Which
group of a size goes where is worked out where the groups are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseq.sources.tables import written


def filled(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each fold gets, one after the other to the lightest.

    The i-th group of a fold comes when the fold holds load + i * size, so the folds take
    the `count` smallest of these numbers; of equal ones, the first folds'.
    """
    low, high = min(loads) - 1, max(loads) + size * count
    while low < high:  # the largest level that takes no more than `count`
        level = (low + high + 1) // 2
        taken = sum(max(0, (level - load) // size + 1) for load in loads)
        low, high = (level, high) if taken <= count else (low, level - 1)
    out = [max(0, (low - load) // size + 1) for load in loads]
    rest = count - sum(out)
    for fold, load in enumerate(loads):
        if rest and load + out[fold] * size == low + 1:
            out[fold] += 1
            rest -= 1
    return out


def _turn(level: Column, fold: Column, loads: Column, size: Column) -> Column:
    """0-based place of (level, fold) among all (load + i * size, fold): whose turn it is."""
    before = F.transform(loads, lambda load, other: F.greatest(F.lit(0), F.when(
        other < fold, F.floor((level - load) / size) + 1).otherwise(F.ceil((level - load) / size))))
    return F.aggregate(before, F.lit(0).cast("long"), lambda a, b: a + b)


def group_folds(rows: DataFrame, k: int, by: str = "group") -> DataFrame:
    """(group, n, fold): groups from largest to smallest, equally large ones by name, each to
    the fold with the fewest rows so far (the first of equally light ones)."""
    sizes = written(rows.groupBy(by).agg(F.count("*").alias("n")), "group_sizes")
    loads, plan = [0] * k, []
    for r in sizes.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        takes = filled(loads, r.n, r.c)
        plan += [(r.n, fold, takes[fold], loads[fold], list(loads)) for fold in range(k) if takes[fold]]
        loads = [load + t * r.n for load, t in zip(loads, takes)]
    turns = rows.sparkSession.createDataFrame(plan, "n long, fold int, takes int, load long, loads array<long>")
    turns = turns.select("n", "fold", "loads", "load", F.explode(F.sequence(F.lit(0), F.col("takes") - 1)).alias("i"))
    turns = turns.select("n", "fold", _turn(F.col("load") + F.col("i") * F.col("n"), F.col("fold"),
                                            F.col("loads"), F.col("n")).alias("turn"))
    order = F.row_number().over(Window.partitionBy("n").orderBy(by)) - 1
    return sizes.withColumn("turn", order.cast("long")).join(turns, ["n", "turn"]).select(by, "n", "fold")
