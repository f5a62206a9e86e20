"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies, `target / size` of its source.
The fractional parts are rounded by pivotal steps: two documents exchange mass
(words) at random, keeping its expectation, until one of them is integral. A
document left over by a chunk meets those of other chunks one level higher, in a
reduction tree whose fan-in is fixed, so no task ever holds a whole source.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseq.llm.base import n_words, query, stored, table

CHUNK = 1024
FAN = 256
_EDGE = 1e-12


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, place): sources numbered by code point, null last.

    Numbers are exact without one task sorting all sources: each range of the
    global order counts its own, and offsets come from one row per range.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = stored(sums.orderBy(F.asc_nulls_last("source"))
                    .withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_range").agg(F.count("*").alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_last("source"))
    return (placed.join(starts, "_range")
            .withColumn("place", F.col("_start") + F.row_number().over(inside) - 1)
            .drop("_range", "_start"))


def mix_targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
                most: float = 2.0) -> DataFrame:
    """Add `target`: `share` of all words by weight, at most `most` times the source's own.

    What a capped source leaves is shared again by weight. Each round of that is
    one sum over the table of sources; it ends when no further source is capped.
    """
    choice: Column = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                  (F.col("place") % len(weights) + 1).cast("int"))
    table_ = stored(sources.withColumn("_w", choice)
                    .withColumn("_cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = table_.agg(F.sum("source_size").alias("s"), F.sum("_w").alias("w")).first()
    budget = share * (total.s or 0)
    level, capped = (budget / total.w if total.w else 0.0), -1
    while budget:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        row = table_.agg(F.count_if(full).alias("n"),
                         F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("c"),
                         F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)).alias("w")
                         ).first()
        if row.n == capped or not row.w:
            break
        level, capped = (budget - row.c) / row.w, row.n
    return table_.withColumn("target", F.least("_cap", F.col("_w") * F.lit(level))).drop("_w", "_cap")


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities p in order; returns them and the index of the one left (-1: none).

    Between the carried document and the next one, words move either way, with odds
    that keep both expectations and the sum of p * size.
    """
    p = p.copy()
    left = -1
    for i in range(len(p)):
        if not _EDGE < p[i] < 1 - _EDGE:
            p[i] = round(p[i])
            continue
        if left < 0:
            left = i
            continue
        up = min((1 - p[left]) * size[left], p[i] * size[i])
        down = min(p[left] * size[left], (1 - p[i]) * size[i])
        moved = up if draw[i] * (up + down) < down else -down
        p[left] += moved / size[left]
        p[i] -= moved / size[i]
        for j in (left, i):
            if p[j] <= _EDGE or p[j] >= 1 - _EDGE:
                p[j] = round(p[j])
        if p[left] in (0.0, 1.0):
            left = i if 0.0 < p[i] < 1.0 else -1
    return p, left


def _round_groups(level: int, last: bool, seed: int):
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "k"], ascending=[False, True, True],
                                  ignore_index=True)
        first = group.iloc[0]
        rng = np.random.default_rng([seed, level, int(first["place"]), int(first["chunk"])])
        p, left = pivot(group["p"].to_numpy(float), group["size"].to_numpy(float),
                        rng.random(len(group)))
        if left >= 0 and last:
            p[left] = float(rng.random() < p[left])
            left = -1
        group["p"] = p
        group["open"] = np.arange(len(group)) == left
        return group
    return apply


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
        most: float = 2.0, seed: int = 7) -> DataFrame:
    """Copies of each document in a mix of sources.

    Returns doc_id, source, size, k, source_size, target, copies, taken, one row per
    input row; k numbers rows equal in id, source and size. Null texts have size 0 and take nothing; null sources are a source of
    their own; equal rows are rounded one by one and are interchangeable. Reruns agree:
    chunks and draws depend on the rows alone. An empty table gives no rows.
    """
    slim = stored(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    sources = stored(mix_targets(ranked_sources(slim), weights, share, most), "targets")
    widest = sources.agg(F.max(F.ceil(F.col("n") / CHUNK)).alias("m")).first().m or 1
    rows = (slim.groupBy("source", "doc_id", "size").agg(F.count("*").alias("_c"))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + F.lit(_EDGE))
    rows = (rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
            .withColumn("whole", whole)
            .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - whole))
                        .otherwise(0.0))
            .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "k"),
                                        F.ceil(F.col("n") / CHUNK)))
            .select("doc_id", "source", "size", "k", "source_size", "target", "place", "whole",
                    "p", "chunk"))
    schema = ("doc_id long, source string, size long, k long, source_size long, target double, "
              "place long, whole long, p double, chunk long, open boolean")
    parts, level, width = [], 0, int(widest)
    while True:
        last = width <= 1
        done = stored(rows.groupBy("place", "chunk")
                      .applyInPandas(_round_groups(level, last, seed), schema), f"level{level}")
        parts.append(done.filter(~F.col("open")))
        if last:
            break
        rows = done.filter("open").drop("open").withColumn(
            "chunk", F.floor(F.col("chunk") / FAN).cast("long"))
        level, width = level + 1, -(-width // FAN)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select("doc_id", "source", "size", "k", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """Documents the mix takes, all columns and size, target, copies and taken."""
    names = [c for c in docs.columns if c not in ("size", "target", "copies", "taken")]
    alike = Window.partitionBy("doc_id", "source", "size").orderBy("text")
    rows = (docs.select(*names, n_words("text").alias("size"))
            .withColumn("_mix_k", F.row_number().over(alike)))
    taken = mix(docs, **settings).filter("copies > 0").select(
        F.col("doc_id").alias("_mix_id_"), F.col("source").alias("_mix_source_"), F.col("size").alias("_mix_size_"),
        F.col("k").alias("_mix_k_"), "target", "copies", "taken")
    return (rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_mix_id_"))
                      & F.col("source").eqNullSafe(F.col("_mix_source_"))
                      & (F.col("size") == F.col("_mix_size_")) & (F.col("_mix_k") == F.col("_mix_k_")))
            .select(*names, "size", "target", "copies", "taken"))


@query("op9_source_mix")
def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")
