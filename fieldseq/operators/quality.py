"""Inventory, sampling and data-quality checks over matches and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.operators.skew import lead_within, top_k
from fieldseq.spec import DEFAULT_GRID, ORDER_CHUNK, GridSpec


def inventory(matches: DataFrame) -> DataFrame:
    """Per competition and season: matches, flagged ones, distinct teams, date range.

    The row with null competition is the total. Most flagged, then largest first.
    """
    sides = matches.select("competition", "season", "match_date", "has_360",
                           F.posexplode(F.array("home_team", "away_team")).alias("side", "team"))
    once = F.col("side") == 0
    return (sides.rollup(F.struct("competition", "season").alias("key"))
            .agg(F.count_if(once).alias("matches"),
                 F.count_if(once & F.col("has_360")).alias("matches_360"),
                 F.count_distinct("team").alias("teams"), F.min("match_date").alias("first"),
                 F.max("match_date").alias("last"))
            .select("key.competition", "key.season", "matches", "matches_360", "teams", "first",
                    "last")
            .orderBy(F.desc("matches_360"), F.desc("matches")))


def totals_by(matches: DataFrame, competitions: DataFrame, by: str) -> DataFrame:
    """Match totals per attribute of the competition, e.g. its gender."""
    known = competitions.select("competition_id", "season_id", by).distinct()
    return (matches.join(known, ["competition_id", "season_id"]).groupBy(by)
            .agg(F.count("*").alias("matches"), F.count_if("has_360").alias("matches_360")))


def busiest(rows: DataFrame, by: str, n: int = 1) -> DataFrame:
    """Groups with the most rows."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def earliest_per_group(matches: DataFrame, by: Sequence[str], date: str, key: str,
                       n: int) -> DataFrame:
    return top_k(matches, by, [F.col(date).asc_nulls_last(), F.col(key)], n)


def seeded_order(key: Column, seed: int) -> Column:
    """Reproducible shuffle key."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)))


def sample_per_group(rows: DataFrame, by: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group in a seeded order."""
    return top_k(rows, by, [seeded_order(F.col(key), seed), F.col(key)], n, rank="draw")


def best_per_flag(matches: DataFrame, n: int = 2) -> DataFrame:
    """The n competitions with most flagged matches, and the n largest without any."""
    comps = matches.groupBy("competition", "season").agg(
        F.count("*").alias("matches"), F.count_if("has_360").alias("matches_360"))
    comps = comps.withColumn("flagged", F.col("matches_360") > 0)
    size = F.when(F.col("flagged"), F.col("matches_360")).otherwise(F.col("matches"))
    return top_k(comps, ["flagged"], [size.desc(), F.col("competition"), F.col("season")], n)


def coordinate_range(events: DataFrame, grid: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Smallest and largest coordinates and whether they fit the field."""
    located = events.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = located.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"),
                       F.min("y").alias("min_y"), F.max("y").alias("max_y"),
                       F.count("*").alias("n"))
    fits = (F.col("max_x") <= grid.length + 0.5) & (F.col("max_y") <= grid.width + 0.5)
    return ends.withColumn("passes", fits)


def attack_direction(shots: DataFrame, half: float = 60.0, share: float = 0.97) -> DataFrame:
    """Share of shots in the attacking half, per period and overall (period null)."""
    return (shots.rollup("period")
            .agg(F.count("*").alias("n"), F.avg((F.col("x") > half).cast("int")).alias("forward"))
            .withColumn("passes", F.col("forward") > share))


def missing_groups(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"),
                      F.count_if(F.col("possession").isNull()).alias("no_possession"),
                      F.count_if(F.col("possession_team").isNull()).alias("no_team"))


def shot_coverage(shots: DataFrame) -> DataFrame:
    return shots.agg(F.count("*").alias("n"),
                     F.avg(F.col("provider_xg").isNotNull().cast("int")).alias("with_xg"),
                     F.avg((F.coalesce(F.size("freeze_frame"), F.lit(0)) > 0).cast("int"))
                     .alias("with_frame"))


def companion_presence(matches: DataFrame, present: DataFrame) -> DataFrame:
    """Do companion files exist where, and only where, matches are flagged?"""
    marked = present.select("match_id").distinct().withColumn("_there", F.lit(True))
    return (matches.join(marked, "match_id", "left").groupBy("has_360")
            .agg(F.count("*").alias("matches"), F.count_if(F.col("_there")).alias("present")))


def order_disagreement(events: DataFrame, time: Sequence[str], order: str = "idx",
                       width: int = ORDER_CHUNK) -> DataFrame:
    """Per match: does the time order differ from the index order?

    A stable sort by time keeps the index order exactly when no event is
    followed by an earlier one, so only neighbours are compared.
    """
    keyed = events.select("match_id", order, F.struct(*time).alias("_time"))
    led = lead_within(keyed, ["match_id"], order, {"_time": "_next_time"}, width)
    back = F.coalesce(F.col("_next_time") < F.col("_time"), F.lit(False))
    return led.groupBy("match_id").agg(F.bool_or(back).alias("disagrees"))


def clock_restarts(events: DataFrame, timestamp: str, prefix: str, order: str = "idx") -> DataFrame:
    """Per match: has it several periods that all begin at the start of the clock?"""
    firsts = events.groupBy("match_id", "period").agg(
        F.min_by(timestamp, order).alias("first"))
    return firsts.groupBy("match_id").agg(
        F.count("*").alias("periods"),
        ((F.count("*") > 1) & F.bool_and(F.col("first").startswith(prefix))).alias("restarts"))


def type_frequency(events: DataFrame, n: int = 25) -> DataFrame:
    return (events.groupBy("type").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "type").limit(n))


def shot_range(shots: DataFrame, match_id: Column | None = None) -> DataFrame:
    """Coordinate range of one match's shots; without an id, of the busiest match."""
    if match_id is None:
        one = busiest(shots, "match_id").select("match_id")
        chosen = shots.join(one, "match_id", "left_semi")
    else:
        chosen = shots.filter(F.col("match_id") == match_id)
    return chosen.groupBy("match_id").agg(
        F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"))

