"""Filters of a table of queries, indexed by what they ask for.

Every distinct predicate of all queries (a value of a field, a band, a flag, a part of the
token line) has one number. A query is a list of the numbers it needs, and two thresholds;
one without filters has an empty list and costs nothing. Items are probed once: each gets
the numbers it satisfies, however many queries ask for them. An item may be returned when
it holds as many of a query's numbers as the query needs and reaches its thresholds.
Nothing is ever written per pair of query and item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.operators.automaton import occurrences
from fieldseq.operators.filters import EQUALITY
from fieldseq.operators.skew import spread_join, stacked
from fieldseq.sources.tables import written

FLAGS = ("ended_in_shot", "ended_in_goal")
BANDS = {"start_band": "start_zone", "end_band": "end_zone"}
_PART = "must_include="
#: Distinct pairs of thresholds of queries without other filters that are tested at once.
STEPS = 10_000
#: Predicates, or queries, that may be broadcast to the items.
FEW = 100_000


def _key(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def _wanted(filters: Column) -> Column:
    parts = F.coalesce(filters["must_include"], F.array().cast("array<string>"))
    single = F.array(*[_key(n, filters[n]) for n in (*EQUALITY, *BANDS, *FLAGS)])
    return F.array_distinct(F.concat(F.array_compact(single), F.transform(
        F.filter(parts, lambda p: p.isNotNull()), lambda p: F.concat(F.lit(_PART), p))))


def _offered() -> Column:
    """Keys an item row has: its values, and what stands before each hyphen of its zones."""
    single = F.array_compact(F.array(*[_key(n, F.col(n)) for n in (*EQUALITY, *FLAGS)]))
    return F.concat(single, *[_before_hyphens(band, zone) for band, zone in BANDS.items()])


def _before_hyphens(band: str, zone: str) -> Column:
    cut = F.split(zone, "-")
    ends = F.when(F.size(cut) > 1, F.sequence(F.lit(1), F.size(cut) - 1))
    names = F.transform(ends, lambda i: _key(band, F.array_join(F.slice(cut, F.lit(1), i), "-")))
    return F.coalesce(names, F.array().cast("array<string>"))


@dataclass(frozen=True)
class PredicateIndex:
    """`predicates(key, pid)` and `needs(qid, needs, min_xg, min_events)`, both stored."""

    predicates: DataFrame
    needs: DataFrame
    query_id: str = "qid"

    def probe(self, items: DataFrame, item_id: str = "uid") -> DataFrame:
        """(id, held, xg_sum, n_events), one row per item: the predicates it satisfies."""
        plain = self.predicates.filter(~F.col("key").startswith(_PART))
        keyed = items.select(item_id, *EQUALITY, *FLAGS).select(
            item_id, F.explode(_offered()).alias("key"))
        found = _met(keyed, plain, "key", item_id).select(item_id, "pid")
        parts = self.predicates.filter(F.col("key").startswith(_PART)).select(
            F.col("pid").alias("number"), F.expr(f"substring(key, {len(_PART) + 1})").alias("phrase"))
        said = occurrences(items, parts, item_id, "token_string", once=True)
        numbers = {"xg_sum": F.nanvl(F.col("xg_sum").cast("double"), F.lit(float("inf"))),
                   "n_events": F.col("n_events").cast("long")}
        none = [F.lit(None).cast(t).alias(n) for n, t in (("xg_sum", "double"), ("n_events", "long"))]
        rows = stacked([
            items.select(item_id, F.lit(None).cast("long").alias("pid"), F.lit(True).alias("_item"),
                         *[value.alias(n) for n, value in numbers.items()]),
            found.select(item_id, "pid", F.lit(False).alias("_item"), *none),
            said.select(item_id, F.col("number").alias("pid"), F.lit(False).alias("_item"), *none)])
        return rows.groupBy(item_id).agg(
            F.array_sort(F.collect_set("pid")).alias("held"),
            *[F.max_by(n, F.col("_item")).alias(n) for n in numbers])

    def asked(self, rows: DataFrame) -> DataFrame:
        """Rows of queries with what their query needs."""
        return rows.join(self.needs, self.query_id)


def _met(rows: DataFrame, table: DataFrame, key: str, item_id: str, few: int | None = None) -> DataFrame:
    """Exploded rows of items joined to a stored table on a key.

    Rows are never the broadcast side: Spark estimates them by the files of the items, before
    they are exploded.
    """
    if table.count() <= (FEW if few is None else few):
        return rows.join(F.broadcast(table), key)
    return spread_join(rows.hint("merge"), table, [key], F.col(item_id))


def _reaches(min_xg: Column, min_events: Column) -> Column:
    return F.coalesce((min_xg.isNull() | (F.col("xg_sum") >= min_xg))
                      & (min_events.isNull() | (F.col("n_events") >= min_events)), F.lit(False))


def admits() -> Column:
    """Whether a row with an item's `held` and numbers passes the query's `needs` on it."""
    n = F.size(F.array_intersect("needs", "held"))
    return ((F.size("needs") == 0) | (n == F.size("needs"))) & _reaches(F.col("min_xg"), F.col("min_events"))


def candidates(needs: DataFrame, held: DataFrame, item_id: str = "uid", query_id: str = "qid",
               few: int | None = None) -> DataFrame:
    """(qid, item) of queries with a numbered predicate, found under the rarest one.

    For counting and checks; queries without numbered predicates are not listed.
    """
    offered = held.select("*", F.explode("held").alias("pid"))
    often = offered.groupBy("pid").agg(F.count("*").alias("_n"))
    asked = needs.filter(F.size("needs") > 0)
    rarest = (asked.select(query_id, F.explode("needs").alias("pid")).join(often, "pid", "left")
              .groupBy(query_id).agg(F.min_by("pid", F.struct(F.coalesce("_n", F.lit(0)), "pid")).alias("pid")))
    met = _met(offered, written(asked.join(rarest, query_id), "rarest"), "pid", item_id, few)
    return met.filter(admits()).select(query_id, item_id)


def counts(needs: DataFrame, held: DataFrame, item_id: str = "uid", query_id: str = "qid",
           steps: int = STEPS) -> DataFrame:
    """(qid, n_candidates) for all queries, without a row per pair for any unfiltered one."""
    n = candidates(needs, held, item_id, query_id).groupBy(query_id).agg(F.count("*").alias("n"))
    bare = needs.filter(F.size("needs") == 0)
    pairs = written(bare.select("min_xg", "min_events").distinct(), "thresholds")
    sizes = held.groupBy("xg_sum", "n_events").agg(F.count("*").alias("c"))
    blocks = max(1, -(-pairs.count() // steps))
    step = F.struct(F.lit(0.0).alias("x"), F.lit(0).alias("e"))
    reached = []
    for b in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("min_xg", "min_events"), F.lit(blocks)) == b).collect()
        limits = F.array(*[F.struct(F.lit(r.min_xg).cast("double").alias("x"), F.lit(r.min_events).cast("int").alias("e"))
                           for r in mine]) if mine else F.slice(F.array(step), 1, 0)
        passed = F.filter(limits, lambda s: _reaches(s["x"], s["e"]))
        reached.append(sizes.select("c", F.explode(passed).alias("s")).groupBy("s").agg(F.sum("c").alias("n"))
                       .select(F.col("s.x").alias("_x"), F.col("s.e").alias("_e"), "n"))
    free = bare.join(stacked(reached), F.col("min_xg").eqNullSafe(F.col("_x"))
                     & F.col("min_events").eqNullSafe(F.col("_e"))).select(query_id, "n")
    return needs.select(query_id).join(stacked([n, free]), query_id, "left").select(
        query_id, F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def build(queries: DataFrame, query_id: str = "qid") -> PredicateIndex:
    """Index of the `filters` of a query table. A null struct is no filter, a NaN threshold none."""
    wanted = queries.select(query_id, "filters", F.explode_outer(_wanted(F.col("filters"))).alias("key"))
    keys = wanted.filter("key is not null").select("key").distinct()
    predicates = written(keys.withColumn("pid", F.monotonically_increasing_id()), "predicates")
    found = spread_join(wanted.filter("key is not null").select(query_id, "key"), predicates, ["key"], F.col(query_id))
    lists = found.groupBy(query_id).agg(F.array_sort(F.collect_set("pid")).alias("needs"))
    least = F.col("filters.min_xg")
    needs = queries.select(query_id, F.when(~F.isnan(least), least).alias("min_xg"),
                           F.col("filters.min_events").alias("min_events")).join(lists, query_id, "left")
    return PredicateIndex(predicates, written(needs.select(
        query_id, F.coalesce("needs", F.array().cast("array<bigint>")).alias("needs"), "min_xg", "min_events"),
        "needs"), query_id)


def may(items: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Items times queries: `admits` for a batch of items and a tile of queries."""
    needs = [np.asarray(x, dtype=np.int64) for x in queries["needs"]]
    known = np.unique(np.concatenate([*needs, np.zeros(0, np.int64)]))
    held = [np.asarray(x, dtype=np.int64) for x in items["held"]]
    flat = np.concatenate([*held, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
    has = np.zeros((len(held), len(known)), dtype=np.float32)
    asks = np.zeros((len(known), len(needs)), dtype=np.float32)
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        has[owner[hit], at[hit]] = 1
        asks[np.searchsorted(known, np.concatenate(needs)), np.repeat(np.arange(len(needs)), [len(x) for x in needs])] = 1
    out = has @ asks == np.array([len(x) for x in needs], dtype=np.float32)
    for value, least in (("xg_sum", "min_xg"), ("n_events", "min_events")):
        limit = queries[least].to_numpy(dtype=np.float64, na_value=np.nan)
        reached = items[value].to_numpy(dtype=np.float64, na_value=np.nan)[:, None] >= limit
        out &= np.isnan(limit) | reached
    return out
