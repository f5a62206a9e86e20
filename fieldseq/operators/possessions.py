"""Grouping events into possessions, and statistics over the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.functions import grammar as G
from fieldseq.operators.skew import order_chunk, spread_join, stacked
from fieldseq.spec import DEFAULT_GRID, ORDER_CHUNK, GridSpec


def build_possessions(events: DataFrame, matches: DataFrame | None = None,
                      grid: GridSpec = DEFAULT_GRID, width: int = ORDER_CHUNK) -> DataFrame:
    """One row per (match, possession) that has at least `grid.min_tokens` own tokens.

    Needs the columns match_id, possession, idx, team, possession_team, type,
    play_pattern, token, minute, second, provider_xg, is_goal. Team and play
    pattern are those of the first event; tokens and shots count only when they
    belong to that team; start, end and duration span all events.

    Grouping runs in two steps. The first works per order range and team and
    leaves one short line of tokens per range; the second joins these lines.
    A huge possession is thereby gathered by as many tasks as it has ranges.
    """
    seconds = G.clock_seconds(F.col("minute"), F.col("second"))
    is_shot = F.coalesce(F.col("type") == "Shot", F.lit(False))
    marked = F.when(F.col("token").isNotNull(), F.struct("idx", "token"))
    per_range = (
        events.filter(F.col("possession").isNotNull())
        .groupBy("match_id", "possession", "team",
                 order_chunk(F.col("idx"), width).alias("chunk"))
        .agg(F.array_sort(F.collect_list(marked)).alias("marked"),
             F.min(F.struct("idx", "possession_team", "play_pattern",
                            seconds.alias("clock"))).alias("first"),
             F.max(F.struct("idx", seconds.alias("clock"))).alias("last"),
             F.bool_or(is_shot).alias("shot"),
             F.bool_or(is_shot & F.coalesce(F.col("is_goal"), F.lit(False))).alias("goal"),
             F.sum(F.when(is_shot, F.coalesce(F.col("provider_xg"), F.lit(0.0)))
                   .otherwise(0.0)).alias("xg"))
    )
    line = F.array_join(F.transform("marked", lambda m: m["token"]), " ")
    part = F.struct("chunk", "team", line.alias("line"), F.size("marked").alias("n"),
                    "shot", "goal", "xg")
    gathered = (
        per_range.select("match_id", "possession", "first", "last", part.alias("part"))
        .groupBy("match_id", "possession")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"),
             F.array_sort(F.collect_list("part")).alias("parts"))
        .withColumn("team", F.col("first")["possession_team"])
        .filter(F.col("team").isNotNull() & (F.col("team") != ""))
        .withColumn("own", F.filter("parts", lambda p: p["team"] == F.col("team")))
    )
    filled = F.filter("own", lambda p: p["n"] > 0)
    token_string = F.array_join(F.transform(filled, lambda p: p["line"]), " ")
    rows = (
        gathered
        .withColumn("n_events", F.aggregate("own", F.lit(0), lambda s, p: s + p["n"]))
        .filter(F.col("n_events") >= grid.min_tokens)
        .withColumn("token_string", token_string)
        .withColumn("zone_path", zone_line(F.col("token_string")))
        .select(
            G.possession_uid(F.col("match_id"), F.col("possession")).alias("uid"),
            "match_id", "possession", "team",
            F.col("first")["play_pattern"].alias("play_pattern"),
            F.col("first")["idx"].alias("start_idx"), F.col("last")["idx"].alias("end_idx"),
            "n_events",
            F.greatest(F.col("last")["clock"] - F.col("first")["clock"], F.lit(0))
            .cast("double").alias("duration_s"),
            F.substring_index("zone_path", " ", 1).alias("start_zone"),
            F.substring_index("zone_path", " ", -1).alias("end_zone"),
            "zone_path", "token_string",
            G.lexeme(F.col("token_string")).alias("lexemes"),
            F.exists("own", lambda p: p["shot"]).alias("ended_in_shot"),
            F.exists("own", lambda p: p["goal"]).alias("ended_in_goal"),
            F.aggregate("own", F.lit(0.0), lambda s, p: s + p["xg"]).alias("xg_sum"))
    )
    return rows if matches is None else with_match(rows, matches)


def zone_line(token_string: Column) -> Column:
    """Zones of a token line, in order, space-joined."""
    return F.regexp_replace(F.regexp_replace(token_string, r"[^ ]*@", ""), r"[+>^]+( |$)", "$1")


def with_match(possessions: DataFrame, matches: DataFrame) -> DataFrame:
    """Add opponent, competition and season; possessions of unknown matches go."""
    meta = matches.select("match_id", "competition", "season", "home_team", "away_team")
    opponent = F.when(F.col("team") == F.col("home_team"), F.col("away_team")) \
        .otherwise(F.col("home_team"))
    return (spread_join(possessions, meta, ["match_id"], F.col("possession"))
            .withColumn("opponent", opponent).drop("home_team", "away_team"))


def skipped_matches(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Match ids with events but no match row."""
    return (events.select("match_id").distinct()
            .join(matches.select("match_id"), "match_id", "left_anti"))


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def possession_statistics(possessions: DataFrame) -> DataFrame:
    return possessions.agg(
        F.count("*").alias("n"), F.avg("n_events").alias("mean_tokens"),
        F.avg("duration_s").alias("mean_duration_s"),
        rate(F.col("ended_in_shot")).alias("shot_rate"),
        rate(F.col("ended_in_goal")).alias("goal_rate"))


def breakdown(possessions: DataFrame, by: str) -> DataFrame:
    """Count, shot rate and mean provider xg per value of a column."""
    return possessions.groupBy(by).agg(
        F.count("*").alias("n"), rate(F.col("ended_in_shot")).alias("shot_rate"),
        rate(F.col("ended_in_goal")).alias("goal_rate"), F.avg("xg_sum").alias("mean_xg"))


def load_statistics(matches: DataFrame, events: DataFrame, shots: DataFrame) -> DataFrame:
    """Row counts of the three tables and the share of shots with a freeze frame."""
    framed = F.lit(None).cast("boolean")
    counts = stacked([
        matches.select(F.lit("matches").alias("table"), framed.alias("f")),
        events.select(F.lit("events").alias("table"), framed.alias("f")),
        shots.select(F.lit("shots").alias("table"), F.col("freeze_frame").isNotNull().alias("f"))])
    return counts.groupBy("table").agg(F.count("*").alias("n"),
                                       rate(F.col("f")).alias("freeze_frame_share"))
