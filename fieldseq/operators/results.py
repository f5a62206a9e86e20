"""Result pages: summaries, ordered detail, playback, facets, model totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.functions import geometry as X
from fieldseq.functions import grammar as G
from fieldseq.operators.skew import lead_within, stacked
from fieldseq.spec import DEFAULT_GRID, ORDER_CHUNK, GridSpec

MIN_STEP_MS, DEFAULT_STEP_MS = 120, 400
PENALTY = "Penalty"


def summaries(rows: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Display columns with defaults for missing numbers and flags."""
    model = F.col("my_xg_sum") if "my_xg_sum" in rows.columns else F.lit(None).cast("double")
    return rows.select(
        *carried, "uid", "match_id", "team", "opponent", "competition", "season", "play_pattern",
        "zone_path", "token_string", "n_events",
        F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"),
        F.coalesce("ended_in_shot", F.lit(False)).alias("ended_in_shot"),
        F.coalesce("ended_in_goal", F.lit(False)).alias("ended_in_goal"),
        F.coalesce("xg_sum", F.lit(0.0)).alias("xg_sum"), model.alias("my_xg_sum"))


def declined(shot_type: Column, distance: Column, angle: Column) -> Column:
    """Why a shot gets no model value: a text, or null when it is scored."""
    return (F.when(shot_type == PENALTY, "penalty, not modelled")
            .when(distance.isNull() | angle.isNull(), "position of the shot unknown"))


def model_totals(shots: DataFrame) -> DataFrame:
    """Model xg per possession over all its shots; null when every shot was declined."""
    return shots.groupBy("match_id", "possession").agg(F.sum("my_xg").alias("my_xg_sum"))


def attach_model_xg(rows: DataFrame, shots: DataFrame) -> DataFrame:
    """Add `my_xg_sum` to rows that have match_id and possession.

    Only shots of the rows' own possessions are read, matched on both keys.
    """
    wanted = rows.select("match_id", "possession").distinct()
    own = shots.join(wanted, ["match_id", "possession"], "left_semi")
    return rows.join(model_totals(own), ["match_id", "possession"], "left")


def detail(events: DataFrame, asked: DataFrame, grid: GridSpec = DEFAULT_GRID) -> DataFrame:
    """All events of the asked possessions, seen from the attacking side.

    `asked` has match_id and possession. Events of the other team are mirrored
    and lose their token. Order the result by (match_id, possession, idx).
    """
    attacking = F.coalesce(F.col("team") == F.col("possession_team"), F.lit(False))
    rows = events.join(asked.select("match_id", "possession").distinct(),
                       ["match_id", "possession"], "left_semi")
    return rows.select(
        G.possession_uid(F.col("match_id"), F.col("possession")).alias("uid"),
        "match_id", "possession", "event_id", "idx",
        F.coalesce("period", F.lit(1)).alias("period"),
        F.coalesce("minute", F.lit(0)).alias("minute"),
        F.coalesce("second", F.lit(0)).alias("second"), "type", "player", "team",
        attacking.alias("is_attacking"),
        X.mirrored(F.col("x"), grid.length, attacking).alias("x"),
        X.mirrored(F.col("y"), grid.width, attacking).alias("y"),
        X.mirrored(F.col("end_x"), grid.length, attacking).alias("end_x"),
        X.mirrored(F.col("end_y"), grid.width, attacking).alias("end_y"), "duration",
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"),
        F.when(attacking, F.col("token")).alias("token"))


def shots_of(details: DataFrame, shots: DataFrame) -> DataFrame:
    """Shots of the detailed possessions with their clock, in order of idx."""
    clock = details.filter(F.col("type") == "Shot").select("event_id", "uid", "idx", "minute")
    return clock.join(shots.drop("idx", "minute", "match_id", "possession"), "event_id")


def timeline(details: DataFrame, shots: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """All events in detail, with columns of their shot; null for events that are none."""
    return details.join(shots.select("event_id", *columns), "event_id", "left")


def last_frame(details: DataFrame, shots: DataFrame) -> DataFrame:
    """Players seen at the last shot that has a freeze frame, per possession."""
    framed = (details.filter(F.col("type") == "Shot").select("uid", "event_id", "idx")
              .join(shots.filter(F.size("freeze_frame") > 0).select("event_id", "freeze_frame"),
                    "event_id"))
    return (framed.groupBy("uid").agg(F.max_by("freeze_frame", "idx").alias("frame"))
            .select("uid", F.posexplode(X.players_on_frame(F.col("frame"))).alias("i", "p"))
            .select("uid", "i", "p.x", "p.y", "p.teammate", "p.keeper"))


def playback(details: DataFrame, width: int = ORDER_CHUNK) -> DataFrame:
    """One step per located event: where the ball goes next and for how long."""
    located = details.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    led = lead_within(located, ["match_id", "possession"], "idx", {"x": "_nx", "y": "_ny"}, width)
    ms = F.floor(F.coalesce("duration", F.lit(DEFAULT_STEP_MS / 1000)) * 1000 + 0.5)
    return led.select(
        "uid", "event_id", "idx", "x", "y",
        F.coalesce("end_x", "_nx", "x").alias("to_x"),
        F.coalesce("end_y", "_ny", "y").alias("to_y"),
        F.greatest(F.lit(MIN_STEP_MS), ms).cast("int").alias("ms"),
        F.coalesce("token", "type").alias("label"), "is_attacking", "under_pressure",
        (F.col("type") == "Shot").alias("is_shot"))


def shot_comparison(shots: DataFrame, events: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Model and provider xg of each shot side by side, with clock and decline reason."""
    clock = events.select("event_id", F.col("minute").alias("minute"))
    reason = declined(F.col("shot_type"), F.col("distance"), F.col("angle"))
    return shots.drop("minute").join(clock, "event_id").select(
        "event_id", "match_id", "player", "minute", "team", "x", "y", "play_pattern", "distance",
        "angle", "body_part", "shot_type",
        F.coalesce("is_goal", F.lit(False)).alias("is_goal"), "provider_xg", "my_xg",
        F.when(F.col("my_xg").isNull(), reason).alias("my_xg_note"),
        (held_out if held_out is not None else F.lit(None).cast("boolean")).alias("in_holdout"),
        "n_def_in_cone", "dist_nearest_def", "gk_dist_to_goal", "gk_off_line")


def shot_panel(shots: DataFrame) -> DataFrame:
    """Per possession: last shot, number of earlier ones, scored total, gap to the provider."""
    last = F.max_by(F.struct("event_id", "my_xg", "provider_xg"), F.col("idx"))
    return (shots.groupBy("match_id", "possession")
            .agg(last.alias("last"), (F.count("*") - 1).alias("n_earlier"),
                 F.count("my_xg").alias("n_scored"), F.sum("my_xg").alias("total"))
            .select("match_id", "possession", F.col("last")["event_id"].alias("last_event_id"),
                    F.col("last")["my_xg"].alias("last_my_xg"), "n_earlier", "n_scored", "total",
                    (F.col("last")["my_xg"] - F.col("last")["provider_xg"]).alias("gap")))


def facets(possessions: DataFrame) -> DataFrame:
    """Distinct values of the choosable columns with their counts, in one pass."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
                       for c in ("competition", "team", "play_pattern")])
    return (possessions.select(F.explode(fields).alias("f")).select("f.field", "f.value")
            .groupBy("field", "value").agg(F.count("*").alias("n")))


def corpus_counts(**tables: DataFrame) -> DataFrame:
    """Row count of each named table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
             for name, df in tables.items()]
    return stacked(parts)
