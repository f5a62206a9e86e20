"""Grid constants, fixed vocabularies and table schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# These names and numbers define the token grammar, so stored
# token strings are only comparable when they agree.
BANDS = ("D", "M", "F")
CHANNELS = ("L", "LI", "C", "RI", "R")
ACTIONS = ("PASS", "CROSS", "THROUGH", "SWITCH", "CARRY", "DRIB", "SHOT",
           "RECV", "RECOV", "DUEL", "CLR", "INT", "LOSS", "SETP")
TYPE_TO_ACTION = {
    "Carry": "CARRY",
    "Dribble": "DRIB",
    "Shot": "SHOT",
    "Ball Receipt*": "RECV",
    "Ball Recovery": "RECOV",
    "Duel": "DUEL",
    "Clearance": "CLR",
    "Interception": "INT",
    "Miscontrol": "LOSS",
    "Dispossessed": "LOSS",
}
RESTART_PASS_TYPES = ("Corner", "Free Kick", "Throw-in", "Goal Kick", "Kick Off")
ZONES = tuple(f"{b}-{c}" for b in BANDS for c in CHANNELS)

# Order values of one possession are cut into ranges of this many before rows
# are gathered, so no single task ever gathers more than this many rows.
ORDER_CHUNK = 1 << 17


@dataclass(frozen=True)
class GridSpec:
    """A rectangular field cut into 3 bands along x and 5 channels across y."""

    length: float = 120.0
    width: float = 80.0
    band_width: float = 40.0
    channel_width: float = 16.0
    progressive: float = 12.0
    box_x: float = 102.0
    box_y_min: float = 18.0
    box_y_max: float = 62.0
    switch_dy: float = 30.0
    switch_dx: float = 20.0
    min_tokens: int = 3
    goal_x: float = 120.0
    goal_y: float = 40.0
    post_low_y: float = 36.0
    post_high_y: float = 44.0


DEFAULT_GRID = GridSpec()

_NAMED = T.StructType([T.StructField("name", T.StringType())])
_POINT = T.ArrayType(T.DoubleType())

FREEZE_FRAME = T.ArrayType(T.StructType([
    T.StructField("location", _POINT),
    T.StructField("position", _NAMED),
    T.StructField("teammate", T.BooleanType()),
]))

RAW_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("period", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("minute", T.IntegerType()),
    T.StructField("second", T.IntegerType()),
    T.StructField("type", _NAMED),
    T.StructField("play_pattern", _NAMED),
    T.StructField("possession", T.LongType()),
    T.StructField("possession_team", _NAMED),
    T.StructField("team", _NAMED),
    T.StructField("player", _NAMED),
    T.StructField("position", _NAMED),
    T.StructField("location", _POINT),
    T.StructField("under_pressure", T.BooleanType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("pass", T.StructType([
        T.StructField("end_location", _POINT),
        T.StructField("cross", T.BooleanType()),
        T.StructField("technique", _NAMED),
        T.StructField("type", _NAMED),
    ])),
    T.StructField("carry", T.StructType([T.StructField("end_location", _POINT)])),
    T.StructField("shot", T.StructType([
        T.StructField("end_location", _POINT),
        T.StructField("body_part", _NAMED),
        T.StructField("technique", _NAMED),
        T.StructField("type", _NAMED),
        T.StructField("first_time", T.BooleanType()),
        T.StructField("outcome", _NAMED),
        T.StructField("statsbomb_xg", T.DoubleType()),
        T.StructField("freeze_frame", FREEZE_FRAME),
    ])),
])

RAW_MATCH = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("competition", T.StructType([
        T.StructField("competition_name", T.StringType())])),
    T.StructField("season", T.StructType([
        T.StructField("season_name", T.StringType())])),
    T.StructField("match_date", T.StringType()),
    T.StructField("home_team", T.StructType([
        T.StructField("home_team_name", T.StringType())])),
    T.StructField("away_team", T.StructType([
        T.StructField("away_team_name", T.StringType())])),
    T.StructField("home_score", T.IntegerType()),
    T.StructField("away_score", T.IntegerType()),
    T.StructField("match_status_360", T.StringType()),
])

RAW_COMPETITION = T.StructType([
    T.StructField("competition_id", T.LongType()),
    T.StructField("season_id", T.LongType()),
    T.StructField("competition_name", T.StringType()),
    T.StructField("season_name", T.StringType()),
    T.StructField("competition_gender", T.StringType()),
])

MATCH_COLUMNS = ("match_id", "competition_id", "season_id", "competition", "season",
                 "match_date", "home_team", "away_team", "home_score", "away_score",
                 "has_360")
EVENT_COLUMNS = ("event_id", "match_id", "idx", "period", "minute", "second", "type",
                 "play_pattern", "possession", "possession_team", "team", "player",
                 "position", "x", "y", "end_x", "end_y", "under_pressure", "duration",
                 "token")
SHOT_COLUMNS = ("event_id", "match_id", "competition_id", "season_id", "team", "player",
                "x", "y", "distance", "angle", "body_part", "technique", "shot_type",
                "first_time", "under_pressure", "play_pattern", "is_goal", "provider_xg",
                "freeze_frame", "n_def_in_cone", "dist_nearest_def", "gk_dist_to_goal",
                "gk_off_line")
SUMMARY_COLUMNS = ("uid", "match_id", "team", "opponent", "competition", "season",
                   "play_pattern", "zone_path", "token_string", "n_events", "duration_s",
                   "ended_in_shot", "ended_in_goal", "xg_sum")
