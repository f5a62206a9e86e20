"""Reads the flat click-stream style `events` table as field events.

Gives the same columns the JSON reader gives, so that every operator can be run
on any table with an id, a user, a kind and a number. All rules are row-local
except the end point, which is the place of the user's next event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.functions import geometry as X
from fieldseq.functions import grammar as G
from fieldseq.operators.skew import lead_within, spread_join

# Event ids are global, so ranges of this many ids hold at most as many rows.
ID_CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(selector, names: tuple[str, ...]):
    expr = F.when(selector == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        expr = expr.when(selector == i, name)
    return expr


def field_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    of_type = (F.when(F.col("event_type") == "view", "Ball Receipt*")
               .when(F.col("event_type") == "click", "Pass")
               .when(F.col("event_type") == "signup", "Carry")
               .when(F.col("event_type") == "error", "Dribble").otherwise("Shot"))
    base = raw.select(
        "event_id", F.col("user_id").alias("match_id"), F.col("event_id").alias("idx"),
        k.alias("k"), "value", of_type.alias("type"),
        F.floor((F.dayofmonth("ts") - 1) / 3).cast("int").alias("possession"),
        ((F.dayofmonth("ts") - 1) * 1440 + F.hour("ts") * 60 + F.minute("ts")).alias("minute"),
        F.second("ts").alias("second"))
    home = F.concat(F.lit("T"), (F.col("match_id") % 10).cast("int").cast("string"))
    away = F.concat(F.lit("T"), ((F.col("match_id") + 1) % 10).cast("int").cast("string"))
    placed = base.select(
        "*", (F.col("k") * F.lit(1.2)).alias("x"),
        (F.col("value") - 80 * F.floor(F.col("value") / 80)).alias("y"),
        home.alias("possession_team"),
        F.when(F.col("k") % 5 == 0, away).otherwise(home).alias("team"),
        _choose((F.col("match_id") + F.col("possession")) % 4,
                ("Regular Play", "From Corner", "From Counter", "From Throw In"))
        .alias("play_pattern"))
    led = lead_within(placed, ["match_id", "possession"], "idx", {"x": "nx", "y": "ny"}, ID_CHUNK)
    has_end = F.col("type").isin("Pass", "Carry", "Shot")
    is_pass = F.col("type") == "Pass"
    ended = led.select(
        "event_id", "match_id", "idx", "k", "value", "type", "possession", "minute", "second",
        "x", "y", "possession_team", "team", "play_pattern",
        (1 + F.col("k") % 2).alias("period"),
        F.concat(F.lit("P"), (F.col("k") % 11).cast("string")).alias("player"),
        F.when(has_end, F.col("nx")).alias("end_x"), F.when(has_end, F.col("ny")).alias("end_y"),
        (F.col("k") % 4 == 0).alias("under_pressure"),
        (F.col("k") / 20.0).alias("duration"),
        F.when(is_pass & (F.col("k") % 13 == 0), "Corner").alias("pass_type"),
        (is_pass & (F.col("k") % 7 == 0)).alias("is_cross"),
        F.when(is_pass & (F.col("k") % 11 == 0), "Through Ball").alias("technique"),
        F.when(F.col("type") == "Shot", F.col("value") / 600).alias("provider_xg"),
        ((F.col("type") == "Shot") & (F.col("value") >= 100)).alias("is_goal"))
    word = G.action(F.col("type"), F.col("pass_type"), F.col("is_cross"), F.col("technique"),
                    F.col("x"), F.col("y"), F.col("end_x"), F.col("end_y"))
    return (ended.withColumn("action", word)
            .withColumn("token", G.token(F.col("action"), F.col("x"), F.col("y"), F.col("end_x"),
                                         F.col("end_y"), F.col("under_pressure"))))


def field_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, standing for a match."""
    m = F.col("match_id")
    firsts = (table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("match_id"))
              .agg(F.min("ts").alias("first_ts")))
    return firsts.select(
        "match_id", (m % 5).alias("competition_id"), (m % 2).alias("season_id"),
        F.concat(F.lit("C"), (m % 5).cast("string")).alias("competition"),
        F.concat(F.lit("S"), (m % 2).cast("string")).alias("season"),
        F.to_date("first_ts").alias("match_date"),
        F.concat(F.lit("T"), (m % 10).cast("string")).alias("home_team"),
        F.concat(F.lit("T"), ((m + 1) % 10).cast("string")).alias("away_team"),
        (m % 3 == 0).alias("has_360"))


def field_shots(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Shots with geometry, a synthetic five-player frame and its features."""
    k = F.col("k")
    frame = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(
        F.array(((k * 7 + i * 13) % 120).cast("double"),
                ((k * 3 + i * 17) % 80).cast("double")).alias("location"),
        F.struct(F.when(i == 5, "Goalkeeper").otherwise("Field").alias("name")).alias("position"),
        (i % 2 == 0).alias("teammate")))
    shots = events.filter(F.col("type") == "Shot").select(
        "event_id", "match_id", "possession", "idx", "minute", "period", "team", "player", "x", "y",
        "play_pattern", "is_goal", "provider_xg", "under_pressure", "k", "value",
        X.distance_to_goal(F.col("x"), F.col("y")).alias("distance"),
        X.goal_angle(F.col("x"), F.col("y")).alias("angle"),
        _choose(k % 3, ("Right Foot", "Left Foot", "Head")).alias("body_part"),
        F.when(k % 6 == 0, "Volley").otherwise("Normal").alias("technique"),
        F.when(k % 17 == 0, "Penalty").otherwise("Open Play").alias("shot_type"),
        (k % 8 == 0).alias("first_time"),
        F.when(k % 9 != 0, frame).alias("freeze_frame"))
    shots = shots.select("*", *[c.alias(n) for n, c in X.freeze_frame_features(
        F.col("freeze_frame"), F.col("x"), F.col("y")).items()])
    ids = matches.select("match_id", "competition_id", "season_id")
    return spread_join(shots, ids, ["match_id"], F.col("event_id"))
