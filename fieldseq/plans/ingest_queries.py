"""Queries on events, shots, possessions and their statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldseq.functions import grammar as G
from fieldseq.operators import possessions as P
from fieldseq.plans.base import (events, matches, possessions, query, r6, shots, stored_possessions,
                                 with_sql)
from fieldseq.sources import keyed, raw, readers
from fieldseq.sources.tables import scratch_dir


@query("event_tokens", with_sql(("ev",), """
select event_id, match_id, possession, type, play_pattern, team, round(x, 6) as x, round(y, 6) as y,
  round(end_x, 6) as end_x, round(end_y, 6) as end_y, under_pressure, action, token,
  replace(replace(replace(replace(replace(lower(token), '@', '_'), '-', '_'), '+', '_prg'),
    '>', '_box'), '^', '_prs') as lexeme
from ev"""))
def event_tokens(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", "match_id", "possession", "type", "play_pattern", "team", r6("x").alias("x"),
        r6("y").alias("y"), r6("end_x").alias("end_x"), r6("end_y").alias("end_y"),
        "under_pressure", "action", "token", G.lexeme(F.col("token")).alias("lexeme"))


@query("shot_geometry", with_sql(("shots",), """
select event_id, match_id, competition_id, season_id, team, player, body_part, technique, shot_type,
  first_time, is_goal, round(distance, 6) as distance, round(angle, 6) as angle,
  round(provider_xg, 6) as provider_xg from shots"""))
def shot_geometry(spark, sf_dir):
    return shots(spark, sf_dir).select(
        "event_id", "match_id", "competition_id", "season_id", "team", "player", "body_part",
        "technique", "shot_type", "first_time", "is_goal", r6("distance").alias("distance"),
        r6("angle").alias("angle"), r6("provider_xg").alias("provider_xg"))


@query("freeze_frame_features", with_sql(("shots",), """
select event_id, n_def_in_cone, round(dist_nearest_def, 6) as dist_nearest_def,
  round(gk_dist_to_goal, 6) as gk_dist_to_goal, round(gk_off_line, 6) as gk_off_line from shots"""))
def freeze_frame_features(spark, sf_dir):
    return shots(spark, sf_dir).select(
        "event_id", F.col("n_def_in_cone").cast("bigint").alias("n_def_in_cone"),
        r6("dist_nearest_def").alias("dist_nearest_def"),
        r6("gk_dist_to_goal").alias("gk_dist_to_goal"), r6("gk_off_line").alias("gk_off_line"))


@query("possessions", with_sql(("poss",), """
select uid, match_id, possession, team, opponent, competition, season, play_pattern, start_idx,
  end_idx, n_events, duration_s, start_zone, end_zone, zone_path, token_string, ended_in_shot,
  ended_in_goal, round(xg_sum, 6) as xg_sum from poss"""))
def possessions_table(spark, sf_dir):
    return possessions(spark, sf_dir).select(
        "uid", "match_id", "possession", "team", "opponent", "competition", "season",
        "play_pattern", "start_idx", "end_idx", F.col("n_events").cast("bigint").alias("n_events"),
        "duration_s", "start_zone", "end_zone", "zone_path", "token_string", "ended_in_shot",
        "ended_in_goal", r6("xg_sum").alias("xg_sum"))


@query("possession_statistics", with_sql(("poss",), """
select count(*) as n, round(avg(n_events), 6) as mean_tokens,
  round(avg(duration_s), 6) as mean_duration_s, round(avg(ended_in_shot::int), 6) as shot_rate,
  round(avg(ended_in_goal::int), 6) as goal_rate from poss"""))
def possession_statistics(spark, sf_dir):
    stats = P.possession_statistics(possessions(spark, sf_dir))
    return stats.select("n", *[r6(c).alias(c) for c in stats.columns[1:]])


@query("possession_breakdown", with_sql(("poss",), """
select play_pattern, count(*) as n, round(avg(ended_in_shot::int), 6) as shot_rate,
  round(avg(ended_in_goal::int), 6) as goal_rate, round(avg(xg_sum), 6) as mean_xg
from poss group by play_pattern"""))
def possession_breakdown(spark, sf_dir):
    b = P.breakdown(possessions(spark, sf_dir), "play_pattern")
    return b.select("play_pattern", "n", *[r6(c).alias(c) for c in b.columns[2:]])


@query("shot_type_breakdown", with_sql(("shots",), """
select shot_type, count(*) as n, round(avg(is_goal::int), 6) as goal_rate,
  round(avg(provider_xg), 6) as mean_xg from shots group by shot_type"""))
def shot_type_breakdown(spark, sf_dir):
    return shots(spark, sf_dir).groupBy("shot_type").agg(
        F.count("*").alias("n"), r6(P.rate(F.col("is_goal"))).alias("goal_rate"),
        r6(F.avg("provider_xg")).alias("mean_xg"))


@query("load_statistics", with_sql(("shots",), """
select 'matches' as "table", count(*) as n, null::double as freeze_frame_share from matches
union all select 'events', count(*), null from ev
union all select 'shots', count(*), round(avg((ff is not null)::int), 6) from shots"""))
def load_statistics(spark, sf_dir):
    s = P.load_statistics(matches(spark, sf_dir), events(spark, sf_dir), shots(spark, sf_dir))
    return s.withColumn("freeze_frame_share", r6("freeze_frame_share"))


def nested_records(spark, sf_dir):
    """The events table as records of nested JSON, as providers deliver them."""
    return raw.nested(events(spark, sf_dir)).withColumn(
        "place", F.get_json_object("text", "$.index").cast("bigint"))


@query("events_from_raw", with_sql(("ev",), """
select event_id, match_id, possession, type, play_pattern, team, round(x, 6) as x, round(y, 6) as y,
  round(end_x, 6) as end_x, round(end_y, 6) as end_y, under_pressure, action, token, is_goal,
  round(provider_xg, 6) as provider_xg from ev"""))
def events_from_raw(spark, sf_dir):
    """Nested records parsed as VARIANT values, checked and flattened back to event rows."""
    flat = readers.flatten_events(raw.sound_events(raw.checked(nested_records(spark, sf_dir)), "match_id"))
    return flat.select(
        F.col("event_id").cast("bigint").alias("event_id"), "match_id",
        F.col("possession").cast("int").alias("possession"), "type", "play_pattern", "team", r6("x").alias("x"),
        r6("y").alias("y"), r6("end_x").alias("end_x"), r6("end_y").alias("end_y"), "under_pressure",
        "action", "token", "is_goal", r6("provider_xg").alias("provider_xg"))


@query("quarantined_events", with_sql(("ev",), """
select event_id as place, match_id, case when event_id % 97 = 0 then 'not JSON' when event_id % 89 = 0 then 'bad index'
    when event_id % 83 = 0 then 'missing type.name' else 'bad location' end as problem
from ev where event_id % 97 = 0 or event_id % 89 = 0 or event_id % 83 = 0 or event_id % 79 = 0"""))
def quarantined_events(spark, sf_dir):
    """Records damaged in four ways by their id, found again with the reason."""
    n, text = F.col("place"), F.col("text")
    hurt = (F.when(n % 97 == 0, F.substring(text, F.lit(1), (F.length(text) / 2).cast("int")))
            .when(n % 89 == 0, F.regexp_replace(text, '"index":([0-9]+)', '"index":"no $1"'))
            .when(n % 83 == 0, F.replace(text, F.lit('"type":{"name":"'), F.lit('"type":{"called":"')))
            .when(n % 79 == 0, F.regexp_replace(text, '"location":\\[', '"location":["left",')).otherwise(text))
    found = raw.quarantine(raw.checked(nested_records(spark, sf_dir).withColumn("text", hurt)))
    return found.select("place", "match_id", F.array_join("problems", ", ").alias("problem"))


def _moved(place):
    return F.when(F.col("possession") % 3 == 0, F.when(F.col("match_id") % 2 == 0, "moved").otherwise(place)) \
        .otherwise(place)


def upserted(spark, sf_dir):
    """Possessions stored by competition, then a third of them again, some in another partition."""
    path = f"{scratch_dir(spark)}/fieldseq-{uuid.uuid4().hex}/keyed"
    items = stored_possessions(spark, sf_dir).select("uid", "match_id", "possession", "competition", "n_events")
    first = items.filter("possession % 2 = 0").select("uid", F.col("competition").alias("part"), "n_events")
    again = items.filter("possession % 3 = 0").select(
        "uid", _moved(F.col("competition")).alias("part"), (F.col("n_events") + 100).alias("n_events"))
    for rows in (first, again):
        keyed.upsert(rows, path, ["uid"], ["part"], buckets=16)
    return path, items


_UPSERTED = """select uid, case when possession % 3 = 0 and match_id % 2 = 0 then 'moved' else competition end as part,
    n_events + case when possession % 3 = 0 then 100 else 0 end as n_events
  from poss where (possession % 2 = 0 or possession % 3 = 0)"""


@query("upsert_round_trip", with_sql(("poss",), _UPSERTED))
def upsert_round_trip(spark, sf_dir):
    path, _ = upserted(spark, sf_dir)
    return keyed.stored_rows(spark, path).select("uid", "part", F.col("n_events").cast("bigint").alias("n_events"))


@query("keyed_lookup", with_sql(("poss",), _UPSERTED + " and possession = 6"))
def keyed_lookup(spark, sf_dir):
    """Rows of some keys, read from the partitions the index names."""
    path, items = upserted(spark, sf_dir)
    found = keyed.lookup(spark, path, ["uid"], ["part"], items.filter("possession = 6").select("uid"), 16)
    return found.select("uid", "part", F.col("n_events").cast("bigint").alias("n_events"))
