"""Finding phrases in texts and relating them by position, for whole tables of texts.

All position logic is ordering within one text, done with windows keyed by the
text id. No step pairs the hits of a text with each other.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseq.operators.automaton import occurrences
from fieldseq.operators.lexicon import NEAR
from fieldseq.operators.skew import spread_join, stacked
from fieldseq.sources.tables import written

INFLECTION = "(?:s|es|ed|ing|d)?"


def phrase_regex(phrases: Sequence[str]) -> str:
    """Any of the phrases as whole words, the longest first, with a common ending."""
    longest_first = sorted(phrases, key=len, reverse=True)
    return r"(?i)\b(" + "|".join(_literal(p) + INFLECTION for p in longest_first) + r")\b"


def _literal(phrase: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", phrase)


def first_match(text: Column, phrases: Sequence[str]) -> Column:
    """struct(phrase, pos) of the leftmost match, or null. Positions are 0-based."""
    pattern = phrase_regex(phrases)
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.struct(F.regexp_extract(text, pattern, 0).alias("phrase"),
                                   (at - 1).alias("pos")))


def hits(texts: DataFrame, lexicon: Mapping[str, Sequence[str]], id_col: str = "id",
         text_col: str = "text") -> DataFrame:
    """Every phrase match: (id, value, value_no, phrase, pos, end).

    Texts are placed by id once; all later windows over the id reuse that.
    """
    per_value = []
    for no, (value, phrases) in enumerate(lexicon.items()):
        pattern = phrase_regex(phrases)
        found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(text_col, pattern, -1), F.length)
        per_value.append(F.struct(F.lit(value).alias("value"), F.lit(no).alias("value_no"),
                                  found.alias("found"), gaps.alias("gaps")))
    placed = texts.select(id_col, text_col).repartition(id_col)
    rows = placed.select(id_col, F.explode(F.array(*per_value)).alias("v"))
    parts = F.arrays_zip(F.col("v.found").alias("phrase"),
                         F.slice("v.gaps", F.lit(1), F.size("v.found")).alias("gap"))
    rows = (rows.filter(F.size("v.found") > 0)
            .select(id_col, "v.value", "v.value_no", F.posexplode(parts).alias("i", "p"))
            .select(id_col, "value", "value_no", "i", "p.phrase", "p.gap"))
    seen = Window.partitionBy(id_col, "value_no").orderBy("i") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("phrase")).over(seen).cast("int")
    return (rows.withColumn("end", end)
            .select(id_col, "value", "value_no", "phrase",
                    (F.col("end") - F.length("phrase")).alias("pos"), "end"))


def resolve_overlaps(found: DataFrame, id_col: str = "id",
                     by: Sequence[str] = ()) -> DataFrame:
    """Keep the leftmost, then longest, of overlapping hits.

    Hits are cut where nothing reaches across; only the hits of one such knot
    are folded over, and a knot is as short as its overlapping phrases.
    """
    keys = [id_col, *by]
    order = [F.col("pos"), F.desc("end"), F.col("value_no")]
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("_new", F.coalesce(F.col("pos") >= reach, F.lit(True)).cast("int"))
    cut = cut.withColumn("_knot", F.sum("_new").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = F.struct("pos", (-F.col("end")).alias("back"), "value_no", "value", "phrase", "end")
    knots = cut.groupBy(*keys, "_knot").agg(F.array_sort(F.collect_list(hit)).alias("h"))
    kept = F.aggregate(
        "h", F.struct(F.slice("h", 1, 0).alias("kept"), F.lit(-1).alias("end")),
        lambda s, x: F.when(x["pos"] >= s["end"], F.struct(
            F.concat(s["kept"], F.array(x)).alias("kept"), x["end"].alias("end"))).otherwise(s),
        lambda s: s["kept"])
    return (knots.select(*keys, F.explode(kept).alias("k"))
            .select(*keys, "k.value", "k.value_no", "k.phrase", "k.pos", "k.end"))


def _swept(found: DataFrame, probes: DataFrame, id_col: str, probe: str,
           hits_first: bool) -> DataFrame:
    """Hits and probes of each text in one stream, ready for ordering by position."""
    h = found.select(id_col, F.col("pos").alias("_at"), F.lit(0 if hits_first else 1).alias("_kind"),
                     F.struct("pos", "value").alias("_hit"), F.lit(None).cast("int").alias(probe))
    p = probes.select(id_col, F.col(probe).alias("_at"),
                      F.lit(1 if hits_first else 0).alias("_kind"),
                      F.lit(None).cast(h.schema["_hit"].dataType).alias("_hit"),
                      F.col(probe).cast("int").alias(probe)).distinct()
    return stacked([h, p])


def preceding(found: DataFrame, probes: DataFrame, id_col: str = "id",
              probe: str = "probe") -> DataFrame:
    """Value of the last hit strictly before each probe position, null if none."""
    w = Window.partitionBy(id_col).orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = _swept(found, probes, id_col, probe, hits_first=False)
    return (swept.withColumn("_last", F.last("_hit", ignorenulls=True).over(w))
            .filter(F.col(probe).isNotNull())
            .select(id_col, probe, F.col("_last")["value"].alias("value")))


def nearest(found: DataFrame, probes: DataFrame, window: int = NEAR, id_col: str = "id",
            probe: str = "probe") -> DataFrame:
    """Value of the closest hit within `window` characters; the earlier one on a tie."""
    w = Window.partitionBy(id_col).orderBy("_at", "_kind")
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    swept = _swept(found, probes, id_col, probe, hits_first=True)
    swept = swept.select("*", F.last("_hit", ignorenulls=True).over(back).alias("_b"),
                         F.first("_hit", ignorenulls=True).over(ahead).alias("_a"))
    db, da = F.col(probe) - F.col("_b")["pos"], F.col("_a")["pos"] - F.col(probe)
    far = F.lit(window + 1)
    use_back = F.coalesce(db, far) <= F.coalesce(da, far)
    distance = F.when(use_back, db).otherwise(da)
    value = F.when(use_back, F.col("_b")["value"]).otherwise(F.col("_a")["value"])
    return (swept.filter(F.col(probe).isNotNull())
            .select(id_col, probe, F.when(distance <= window, value).alias("value")))


def outside(found: DataFrame, spans: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits that touch none of the claimed spans (pos, end) of their text."""
    h = found.select(id_col, F.col("end").alias("_at"), F.lit(0).alias("_kind"),
                     F.struct(*[c for c in found.columns if c != id_col]).alias("_hit"),
                     F.lit(None).cast("int").alias("_reach"))
    s = spans.select(id_col, F.col("pos").alias("_at"), F.lit(1).alias("_kind"),
                     F.lit(None).cast(h.schema["_hit"].dataType).alias("_hit"),
                     F.col("end").cast("int").alias("_reach"))
    w = Window.partitionBy(id_col).orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = stacked([h, s]).withColumn("_far", F.max("_reach").over(w))
    free = F.coalesce(F.col("_far") <= F.col("_hit")["pos"], F.lit(True))
    return swept.filter(F.col("_hit").isNotNull() & free).select(id_col, "_hit.*")


def first_outside(found: DataFrame, spans: DataFrame, id_col: str = "id") -> DataFrame:
    free = outside(found, spans, id_col)
    return free.groupBy(id_col).agg(F.min_by(F.struct("phrase", "pos"), F.col("pos")).alias("m")) \
        .select(id_col, "m.*")


def uncovered(texts: DataFrame, spans: DataFrame, id_col: str = "id",
              text_col: str = "text") -> DataFrame:
    """Words of each text that no span covers."""
    w = Window.partitionBy(id_col).orderBy("pos", "end")
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = spans.select(id_col, "pos", "end").withColumn("from", reach)
    per_text = gaps.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("from"),
                                           F.struct("from", "pos")))).alias("gaps"),
        F.max("end").alias("tail"))
    joined = texts.select(id_col, text_col).join(per_text, id_col, "left")
    pieces = F.transform(
        F.coalesce("gaps", F.array().cast("array<struct<from:int,pos:int>>")),
        lambda g: F.substring(F.col(text_col), g["from"] + 1, g["pos"] - g["from"]))
    tail = F.substring(F.col(text_col), F.coalesce("tail", F.lit(0)) + 1, F.length(text_col))
    line = F.concat_ws(" ", pieces, tail)
    return joined.select(id_col, F.trim(F.regexp_replace(line, r"\s+", " ")).alias("uncovered"))


def longest_entity(texts: DataFrame, names: DataFrame, id_col: str = "id",
                   text_col: str = "text", name_col: str = "name") -> DataFrame:
    """Longest name that stands in each text as whole words, equally long ones by name.

    Only the first occurrence of a name is looked at. Names are numbered by preference, and
    one automaton (or several, for very many names) finds the smallest number in a single
    pass over each text, so nothing but one hit per text leaves a task.
    """
    rank = [-F.length(name_col), F.col(name_col)]
    ordered = (names.filter(F.length(name_col) > 0).select(name_col).distinct()
               .repartitionByRange(*rank).sortWithinPartitions(*rank)
               .select(F.monotonically_increasing_id().alias("number"), name_col,
                       F.lower(name_col).alias("phrase")))
    ordered = written(ordered, "names")
    low = texts.select(id_col, F.lower(text_col).alias("_low"))
    found = occurrences(low, ordered, id_col, "_low", words=True, once=True, leading=True, lowest=True)
    best = found.groupBy(id_col).agg(F.min(F.struct("number", "pos")).alias("m"))
    return spread_join(best.select(id_col, "m.*"), ordered.select("number", name_col), ["number"],
                       F.col(id_col)).select(id_col, name_col, "pos")
