"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseq.llm.base import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of `edges` (a, b) with the smallest node it is connected to.

    Each round hangs the larger neighbours of a node under its smallest neighbour
    (large star), then the smaller ones (small star), until only stars are left.
    Minima are combined before the shuffle, and the joins that follow have one row per
    node on one side, so a hub's edges can be split over tasks. Rounds are written to
    the shared folder. Self-loops are ignored.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(edges.filter("a <> b").select(u, v).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (mark.n, mark.h) == seen or mark.n == 0:
            break
        seen = (mark.n, mark.h)
        both = now.select(F.explode(F.array(
            F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
            F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        lowest = both.groupBy("x").agg(F.min("y").alias("m")).select(
            "x", F.least("x", "m").alias("m"))
        large = (both.filter("y > x").join(lowest, "x")
                 .select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "large_star")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(small.filter("u <> v").distinct(), "small_star")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
