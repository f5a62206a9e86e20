"""Shot geometry and freeze-frame features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldseq.spec import DEFAULT_GRID, GridSpec


def distance_to_goal(x: Column, y: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    return F.hypot(F.lit(grid.goal_x) - x, F.lit(grid.goal_y) - y)


def goal_angle(x: Column, y: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    """Angle in radians under which the goal mouth is seen; 0 exactly on a post."""
    near = F.hypot(F.lit(grid.goal_x) - x, F.lit(grid.post_low_y) - y)
    far = F.hypot(F.lit(grid.goal_x) - x, F.lit(grid.post_high_y) - y)
    mouth = grid.post_high_y - grid.post_low_y
    cosine = (near * near + far * far - F.lit(mouth * mouth)) / (2 * near * far)
    seen = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when((near == 0) | (far == 0), F.lit(0.0)).otherwise(seen)


def _turn(px: Column, py: Column, ax, ay, bx, by) -> Column:
    """Which side of the line a-b the point lies on (sign of the cross product)."""
    return (px - bx) * (ay - by) - (ax - bx) * (py - by)


def in_shot_triangle(px: Column, py: Column, sx: Column, sy: Column,
                     grid: GridSpec = DEFAULT_GRID) -> Column:
    """Is the point inside the triangle shot-post-post, borders included?"""
    gx = F.lit(grid.goal_x)
    low, high = F.lit(grid.post_low_y), F.lit(grid.post_high_y)
    turns = F.array(_turn(px, py, sx, sy, gx, low),
                    _turn(px, py, gx, low, gx, high),
                    _turn(px, py, gx, high, sx, sy))
    return ~((F.array_min(turns) < 0) & (F.array_max(turns) > 0))


def _located(player: Column) -> Column:
    return F.size(player["location"]) >= 2


def _px(player: Column) -> Column:
    return F.get(player["location"], 0)


def _py(player: Column) -> Column:
    return F.get(player["location"], 1)


def _is_keeper(player: Column) -> Column:
    return F.coalesce(player["position"]["name"] == "Goalkeeper", F.lit(False))


def freeze_frame_features(frame: Column, x: Column, y: Column,
                          grid: GridSpec = DEFAULT_GRID) -> dict[str, Column]:
    """Four context columns from the players seen at the moment of a shot.

    A missing or empty frame gives nulls, never zeros. An entry without a
    `teammate` flag counts as a teammate. Of several keepers the last counts.
    """
    opponents = F.filter(frame, lambda p: ~F.coalesce(p["teammate"], F.lit(True)) & _located(p))
    field = F.filter(opponents, lambda p: ~_is_keeper(p))
    keeper = F.try_element_at(F.filter(opponents, _is_keeper), F.lit(-1))
    usable = F.coalesce(F.size(frame) > 0, F.lit(False))
    in_cone = F.size(F.filter(field, lambda p: in_shot_triangle(_px(p), _py(p), x, y, grid)))
    nearest = F.array_min(F.transform(field, lambda p: F.hypot(_px(p) - x, _py(p) - y)))
    return {
        "n_def_in_cone": F.when(usable, in_cone),
        "dist_nearest_def": F.when(usable, nearest),
        "gk_dist_to_goal": F.when(usable, F.hypot(F.lit(grid.goal_x) - _px(keeper),
                                                  F.lit(grid.goal_y) - _py(keeper))),
        "gk_off_line": F.when(usable, F.lit(grid.goal_x) - _px(keeper)),
    }


def players_on_frame(frame: Column) -> Column:
    """Frame entries for display; here a missing `teammate` flag means opponent."""
    return F.transform(
        F.filter(F.coalesce(frame, F.array().cast(
            "array<struct<location:array<double>,position:struct<name:string>,teammate:boolean>>")),
            _located),
        lambda p: F.struct(_px(p).alias("x"), _py(p).alias("y"),
                           F.coalesce(p["teammate"], F.lit(False)).alias("teammate"),
                           _is_keeper(p).alias("keeper")))


def mirrored(value: Column, extent: float, attacking: Column) -> Column:
    """Coordinate seen from the attacking side; null stays null."""
    return F.when(attacking, value).otherwise(F.lit(extent) - value)
