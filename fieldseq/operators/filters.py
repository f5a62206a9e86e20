"""Hard filters: constraints that decide membership before anything is ranked."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.operators.skew import spread_join

EQUALITY = ("team", "opponent", "competition", "season", "play_pattern",
            "start_zone", "end_zone")

FILTER_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in EQUALITY]
    + [T.StructField("start_band", T.StringType()), T.StructField("end_band", T.StringType()),
       T.StructField("ended_in_shot", T.BooleanType()),
       T.StructField("ended_in_goal", T.BooleanType()),
       T.StructField("min_xg", T.DoubleType()), T.StructField("min_events", T.IntegerType()),
       T.StructField("must_include", T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class Filters:
    """Optional constraints of one query; those left None do not constrain."""

    team: str | None = None
    opponent: str | None = None
    competition: str | None = None
    season: str | None = None
    play_pattern: str | None = None
    start_zone: str | None = None
    end_zone: str | None = None
    start_band: str | None = None
    end_band: str | None = None
    ended_in_shot: bool | None = None
    ended_in_goal: bool | None = None
    min_xg: float | None = None
    min_events: int | None = None
    must_include: tuple[str, ...] = ()

    def is_empty(self) -> bool:
        return not self._terms()

    def given(self) -> tuple[str, ...]:
        """Names of the set fields; `False` and `0` count as set."""
        return tuple(f.name for f in fields(self)
                     if getattr(self, f.name) is not None and getattr(self, f.name) != ())

    def as_row(self) -> tuple:
        values = [getattr(self, f.name) for f in FILTER_TYPE.fields]
        return (*values[:-1], list(self.must_include) or None)

    def overridden_by(self, explicit: Filters) -> Filters:
        """These filters with every field the explicit ones set replaced."""
        return replace(self, **{n: getattr(explicit, n) for n in explicit.given()})

    def _terms(self) -> list[Column]:
        terms = [F.col(n) == getattr(self, n) for n in EQUALITY if getattr(self, n) is not None]
        if self.start_band:
            terms.append(F.col("start_zone").startswith(f"{self.start_band}-"))
        if self.end_band:
            terms.append(F.col("end_zone").startswith(f"{self.end_band}-"))
        for n in ("ended_in_shot", "ended_in_goal"):
            if getattr(self, n) is not None:
                terms.append(F.col(n) == getattr(self, n))
        if self.min_xg is not None:
            terms.append(F.col("xg_sum") >= self.min_xg)
        if self.min_events is not None:
            terms.append(F.col("n_events") >= self.min_events)
        terms += [F.col("token_string").contains(part) for part in self.must_include]
        return terms

    def predicate(self) -> Column:
        """All set constraints joined by AND; TRUE when none is set."""
        keep = F.lit(True)
        for term in self._terms():
            keep = term if keep is None else keep & term
        return keep


def pair_predicate(wanted: Column) -> Column:
    """The same rule for a row that carries its query's filters as a struct."""
    keep = F.lit(True)
    for n in EQUALITY:
        keep = keep & (wanted[n].isNull() | (F.col(n) == wanted[n]))
    for band, zone in (("start_band", "start_zone"), ("end_band", "end_zone")):
        keep = keep & (wanted[band].isNull()
                       | F.col(zone).startswith(F.concat(wanted[band], F.lit("-"))))
    for n in ("ended_in_shot", "ended_in_goal"):
        keep = keep & (wanted[n].isNull() | (F.col(n) == wanted[n]))
    keep = keep & (wanted["min_xg"].isNull() | (F.col("xg_sum") >= wanted["min_xg"]))
    keep = keep & (wanted["min_events"].isNull() | (F.col("n_events") >= wanted["min_events"]))
    parts = F.coalesce(wanted["must_include"], F.array().cast("array<string>"))
    keep = keep & F.forall(parts, lambda t: F.contains(F.col("token_string"), t))
    return F.coalesce(keep, F.lit(False))


FILTER_INPUTS = (*EQUALITY, "ended_in_shot", "ended_in_goal", "xg_sum", "n_events",
                 "token_string")


def candidate_pairs(items: DataFrame, queries: DataFrame, item_id: str = "uid",
                    query_id: str = "qid") -> DataFrame:
    """(qid, item) for all items that pass the filters of a query of a table.

    Every query is looked up under one of its equality filters, so it meets only the
    items with that value; queries without any meet all items. Items are spread within
    a key, since one value may hold a large share of them.
    """
    any_key = F.lit("*")

    def key(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value)

    wanted = queries.select(query_id, "filters")
    anchor = F.coalesce(*[key(n, F.col("filters")[n]) for n in EQUALITY], any_key)
    held = F.array(any_key, *[key(n, F.col(n).cast("string")) for n in EQUALITY])
    keyed = items.select(item_id, *FILTER_INPUTS, F.explode(F.array_compact(held)).alias("_key"))
    met = spread_join(keyed, wanted.withColumn("_key", anchor), ["_key"], F.col(item_id))
    return (met.filter(F.col("filters").isNull() | pair_predicate(F.col("filters")))
            .select(query_id, item_id))


def counted(pairs: DataFrame, queries: DataFrame, query_id: str = "qid") -> DataFrame:
    """Candidates per query of a table; queries without any are listed with 0."""
    n = pairs.groupBy(query_id).agg(F.count("*").alias("n"))
    return queries.select(query_id).join(n, query_id, "left").select(
        query_id, F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def merged(parsed: Column, explicit: Column) -> Column:
    """Filter struct in which every non-null explicit field wins."""
    return F.struct(*[F.coalesce(explicit[f.name], parsed[f.name]).alias(f.name)
                      for f in FILTER_TYPE.fields])


def allowed_queries(wanted: Mapping[str, Filters]) -> Column:
    """Ids of all queries whose filters an item row passes, as an array.

    The filters are part of the query text, so this is one row-local expression
    over the items and needs no join.
    """
    hits = F.array(*[F.when(f.predicate(), F.lit(q)) for q, f in wanted.items()])
    return F.array_compact(hits)


def candidates(items: DataFrame, wanted: Mapping[str, Filters], item_id: str = "uid") -> DataFrame:
    return items.select(F.explode(allowed_queries(wanted)).alias("qid"), item_id)


def candidate_counts(items: DataFrame, wanted: Mapping[str, Filters]) -> DataFrame:
    """Candidates per query; queries without any are listed with 0."""
    counts = items.agg(*[F.count_if(f.predicate()).alias(q) for q, f in wanted.items()])
    entries = F.array(*[F.struct(F.lit(q).alias("qid"), F.col(f"`{q}`").alias("n_candidates"))
                        for q in wanted])
    return counts.select(F.explode(entries).alias("e")).select("e.qid", "e.n_candidates")


def given_fields(wanted: Column) -> Column:
    """Names of the set fields of a filter struct."""
    return F.array_compact(F.array(*[F.when(wanted[f.name].isNotNull(), F.lit(f.name))
                                     for f in FILTER_TYPE.fields]))


def unknown_zones(zones: Column, valid: tuple[str, ...]) -> Column:
    """Drawn zones that are not on the grid."""
    return F.array_except(zones, F.array(*[F.lit(z) for z in valid]))
