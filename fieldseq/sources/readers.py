"""Readers of nested event, match and competition JSON, and their flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.functions import geometry as X
from fieldseq.functions import grammar as G
from fieldseq.operators.skew import spread_join
from fieldseq.spec import (DEFAULT_GRID, MATCH_COLUMNS, RAW_COMPETITION, RAW_EVENT, RAW_MATCH,
                           SHOT_COLUMNS, GridSpec)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw nested events of a folder of `{match_id}.json` arrays, with match_id."""
    raw = (spark.read.schema(RAW_EVENT).option("multiLine", True)
           .option("pathGlobFilter", "*.json").json(path))
    return raw.withColumn("match_id", _file_number(F.col("_metadata.file_name")))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Matches of `{competition}/{season}.json` files; ids come from the path.

    A match listed in several files is taken from the last path in sorted order.
    """
    raw = (spark.read.schema(RAW_MATCH).option("multiLine", True)
           .option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
           .withColumn("_path", F.col("_metadata.file_path")))
    ids = r"/(\d+)/(\d+)\.json$"
    flat = raw.select(
        "match_id", F.regexp_extract("_path", ids, 1).cast("bigint").alias("competition_id"),
        F.regexp_extract("_path", ids, 2).cast("bigint").alias("season_id"),
        F.col("competition.competition_name").alias("competition"),
        F.col("season.season_name").alias("season"),
        F.expr("try_cast(match_date as date)").alias("match_date"),
        F.col("home_team.home_team_name").alias("home_team"),
        F.col("away_team.away_team_name").alias("away_team"), "home_score", "away_score",
        F.coalesce(F.col("match_status_360") == "available", F.lit(False)).alias("has_360"),
        "_path")
    return latest(flat, ["match_id"], F.col("_path")).select(*MATCH_COLUMNS)


def read_competitions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_COMPETITION).option("multiLine", True).json(path)


def companion_ids(spark: SparkSession, path: str) -> DataFrame:
    """Match ids that have a companion file; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return files.select(_file_number(F.col("path")).alias("match_id")).distinct()


def _file_number(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.json$", 1).cast("bigint")


def latest(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row per key: the one with the greatest version."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return picked.select(*keys, "_row.*")


def _end(of: str, i: int) -> Column:
    place = F.col(f"`{of}`.end_location")
    return F.when(F.size(place) >= 2, F.get(place, i))


def _end_of(i: int) -> Column:
    kind = F.col("type.name")
    return (F.when(kind == "Pass", _end("pass", i)).when(kind == "Carry", _end("carry", i))
            .when(kind == "Shot", _end("shot", i)))


def flatten_events(raw: DataFrame, grid: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Flat event rows with their token; `provider_xg` and `is_goal` ride along for shots."""
    located = F.size("location") >= 2
    flat = raw.select(
        F.col("id").alias("event_id"), "match_id", F.col("index").alias("idx"), "period", "minute",
        "second", "timestamp", F.col("type.name").alias("type"),
        F.col("play_pattern.name").alias("play_pattern"), "possession",
        F.col("possession_team.name").alias("possession_team"), F.col("team.name").alias("team"),
        F.col("player.name").alias("player"), F.col("position.name").alias("position"),
        F.when(located, F.get("location", 0)).alias("x"),
        F.when(located, F.get("location", 1)).alias("y"),
        _end_of(0).alias("end_x"), _end_of(1).alias("end_y"),
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"), "duration",
        F.col("`pass`.type.name").alias("pass_type"),
        F.coalesce("`pass`.cross", F.lit(False)).alias("is_cross"),
        F.col("`pass`.technique.name").alias("technique"),
        F.col("shot.statsbomb_xg").alias("provider_xg"),
        F.coalesce(F.col("shot.outcome.name") == "Goal", F.lit(False)).alias("is_goal"))
    word = G.action(F.col("type"), F.col("pass_type"), F.col("is_cross"), F.col("technique"),
                    F.col("x"), F.col("y"), F.col("end_x"), F.col("end_y"), grid)
    return (flat.withColumn("action", word)
            .withColumn("token", G.token(F.col("action"), F.col("x"), F.col("y"), F.col("end_x"),
                                         F.col("end_y"), F.col("under_pressure"), grid)))


def flatten_shots(raw: DataFrame, matches: DataFrame, grid: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Located shots with geometry and freeze-frame features."""
    x, y = F.get("location", 0), F.get("location", 1)
    shots = raw.filter((F.col("type.name") == "Shot") & (F.size("location") >= 2)).select(
        F.col("id").alias("event_id"), "match_id", F.col("team.name").alias("team"),
        F.col("player.name").alias("player"), x.alias("x"), y.alias("y"),
        X.distance_to_goal(x, y, grid).alias("distance"), X.goal_angle(x, y, grid).alias("angle"),
        F.col("shot.body_part.name").alias("body_part"),
        F.col("shot.technique.name").alias("technique"),
        F.col("shot.type.name").alias("shot_type"),
        F.coalesce("shot.first_time", F.lit(False)).alias("first_time"),
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"),
        F.col("play_pattern.name").alias("play_pattern"),
        F.coalesce(F.col("shot.outcome.name") == "Goal", F.lit(False)).alias("is_goal"),
        F.col("shot.statsbomb_xg").alias("provider_xg"),
        F.col("shot.freeze_frame").alias("freeze_frame"))
    shots = shots.select("*", *[c.alias(n) for n, c in X.freeze_frame_features(
        F.col("freeze_frame"), F.col("x"), F.col("y"), grid).items()])
    ids = matches.select("match_id", "competition_id", "season_id")
    return spread_join(shots, ids, ["match_id"], F.col("event_id")).select(*SHOT_COLUMNS)
