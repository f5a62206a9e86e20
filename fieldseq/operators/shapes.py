"""Shape search for tables of drawn shapes.

A path has a signature: for each ordered pair of grid zones, whether the second is visited
after the first, and for each zone, whether it is visited at all. A path can only hold a
shape whose own pairs are all in its signature. Shapes are looked up under their rarest
pair, so a path meets only shapes it may hold; a subsequence scan decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.functions import grammar as G
from fieldseq.operators import predicate_index
from fieldseq.operators.skew import spread_join
from fieldseq.sources.tables import written
from fieldseq.spec import ZONES

#: Codes of a zone: one per zone that may follow, and one for being visited.
WIDTH = len(ZONES) + 1


def _grid() -> Column:
    return F.array(*[F.lit(z) for z in ZONES])


def signature(path: Column) -> Column:
    """One word of bits per grid zone: which zones come later, and, last, whether it is visited."""
    back = F.reverse(path)
    first = F.transform(_grid(), lambda z: F.array_position(path, z).cast("int"))
    last = F.transform(_grid(), lambda z: F.when(F.array_position(back, z) > 0, F.size(path) + 1
                                                 - F.array_position(back, z)).otherwise(0).cast("int"))
    bits = [F.lit(1 << i) for i in range(WIDTH)]
    return F.transform(first, lambda at: F.when(at > 0, F.aggregate(
        F.zip_with(last, F.array(*bits[:-1]), lambda end, bit: F.when(end > at, bit).otherwise(0)),
        bits[-1], lambda word, bit: word.bitwiseOR(bit))).otherwise(0))


def codes(drawn: Column) -> Column:
    """Numbers of all ordered pairs and zones of a shape; null for a zone off the grid."""
    def number(zone: Column) -> Column:
        at = F.array_position(_grid(), zone)
        return F.when(at > 0, (at - 1).cast("int"))
    return F.array_distinct(F.flatten(F.transform(drawn, lambda zone, i: F.concat(
        F.array(number(zone) * WIDTH + (WIDTH - 1)),
        F.transform(F.filter(drawn, lambda _, j: j > i), lambda later: number(zone) * WIDTH + number(later))))))


def _has(words: Column, code: Column) -> Column:
    word = F.element_at(words, (F.floor(code / WIDTH) + 1).cast("int"))
    return F.getbit(word, F.pmod(code, F.lit(WIDTH)).cast("int")) == 1


def prepared(shapes: DataFrame, query_id: str = "qid") -> DataFrame:
    """Shapes (qid, zones[, filters]) with repeats collapsed and the codes they need.

    Null, empty and off-grid shapes match nothing and are left out; `unknown_shapes` has them.
    """
    known = shapes.withColumn("drawn", G.collapse_repeats(F.col("zones"))).withColumn("codes", codes(F.col("drawn")))
    return known.filter((F.size("drawn") > 0) & ~F.exists("codes", lambda c: c.isNull())).drop("zones")


def unknown_shapes(shapes: DataFrame, query_id: str = "qid") -> DataFrame:
    """(qid, zones) of shapes without zones or with zones that are not on the grid."""
    usable = F.coalesce((F.size("zones") > 0) & F.forall("zones", lambda z: z.isin(*ZONES)), F.lit(False))
    return shapes.filter(~usable).select(query_id, "zones")


def matches(possessions: DataFrame, shapes: DataFrame, query_id: str = "qid") -> DataFrame:
    """(qid, uid, n_events, coverage) of all possessions whose path holds a shape of the table.

    With a `filters` column, only possessions that pass the filters of the shape.
    """
    asked = prepared(shapes, query_id)
    paths = possessions.select("uid", "n_events", G.collapse_repeats(F.split("zone_path", " ")).alias("path"))
    paths = paths.withColumn("words", signature(F.col("path")))
    if "filters" in shapes.columns:
        index = predicate_index.build(shapes, query_id)
        asked = index.asked(asked.drop("filters"))
        # Both sides have a row per item; the signatures are far larger than the columns they are estimated by.
        paths = paths.drop("n_events").hint("merge").join(index.probe(possessions), "uid")
    paths = written(paths, "paths")
    asked = written(asked, "shapes")
    wanted = sorted(r.c for r in asked.select(F.explode("codes").alias("c")).distinct().collect())
    often = paths.agg(*[F.count_if(_has(F.col("words"), F.lit(c))).alias(f"c{c}") for c in wanted]).first() if wanted else []
    rank = F.create_map(*[F.lit(v) for pair in zip(wanted, often) for v in pair]) if wanted else None
    if rank is None:
        return paths.select(F.lit(None).cast(shapes.schema[query_id].dataType).alias(query_id), "uid", "n_events",
                            F.lit(0.0).alias("coverage")).limit(0)
    rarest = F.array_min(F.transform("codes", lambda c: F.struct(F.element_at(rank, c).alias("n"), c.alias("code"))))
    asked = written(asked.withColumn("code", rarest["code"]), "keyed_shapes")
    # A product with the anchors, because Spark estimates exploded paths as large as before and broadcasts them.
    anchors = paths.sparkSession.createDataFrame([(r.code,) for r in asked.select("code").distinct().collect()], "code int")
    offered = paths.join(F.broadcast(anchors), _has(F.col("words"), F.col("code")))
    met = spread_join(offered, asked, ["code"], F.col("uid"))
    fits = F.forall("codes", lambda c: _has(F.col("words"), c)) & G.is_subsequence(F.col("drawn"), F.col("path"))
    if "filters" in shapes.columns:
        fits = predicate_index.admits() & fits
    return met.filter(fits).select(query_id, "uid", F.col("n_events").cast("int").alias("n_events"),
                                   (F.size("drawn").cast("double") / F.size("path")).alias("coverage"))
