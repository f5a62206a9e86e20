"""Registry of runnable queries, and the shared tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.operators.possessions import build_possessions
from fieldseq.sources.adapter import field_events, field_matches, field_shots, table
from fieldseq.sources.tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

__all__ = ["QUERIES", "ORACLES", "query", "events", "matches", "shots", "possessions",
           "stored_possessions", "table", "r6", "with_sql"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def _described_once(build: Query) -> Query:
    """Keep the description of a derived table (not its rows) for the application's lifetime."""
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, build.__name__, sf_dir)
        if key not in _PLANS:
            _PLANS[key] = build(spark, sf_dir)
        return _PLANS[key]
    return get


@_described_once
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_events(spark, sf_dir)


@_described_once
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_matches(spark, sf_dir)


@_described_once
def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_shots(events(spark, sf_dir), matches(spark, sf_dir))


@_described_once
def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_possessions(events(spark, sf_dir), matches(spark, sf_dir))


def stored_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table in the shared folder, for jobs that read it several times."""
    return written(possessions(spark, sf_dir), "possessions")


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


# --- the same tables in DuckDB SQL, as named common table expressions ---------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, body)


def with_sql(needs: tuple[str, ...], body: str) -> str:
    """`with ...` prelude holding the named tables and what they need, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{n} as ({CTES[n][1]})" for n in order)
    return f"with {parts}\n{body}" if parts else body


cte("ev0", """
  select event_id, ts, user_id as match_id, event_id as idx, event_type, value,
         cast(json_extract(props, '$.k') as int) as k,
         cast(floor((day(ts) - 1) / 3) as int) as possession,
         (day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) as minute,
         second(ts) as second
  from events""")
cte("ev1", """
  select *, k * cast(1.2 as double) as x, value - 80 * floor(value / 80) as y,
    case event_type when 'view' then 'Ball Receipt*' when 'click' then 'Pass'
                    when 'signup' then 'Carry' when 'error' then 'Dribble' else 'Shot' end as type,
    concat('T', cast(match_id % 10 as int)) as possession_team,
    case when k % 5 = 0 then concat('T', cast((match_id + 1) % 10 as int))
         else concat('T', cast(match_id % 10 as int)) end as team,
    case (match_id + possession) % 4 when 0 then 'Regular Play' when 1 then 'From Corner'
         when 2 then 'From Counter' else 'From Throw In' end as play_pattern,
    1 + k % 2 as period, k / 20.0::double as duration,
    concat('P', k % 11) as player
  from ev0""", ("ev0",))
cte("ev2", """
  select *, lead(x) over w as nx, lead(y) over w as ny
  from ev1 window w as (partition by match_id, possession order by event_id)""", ("ev1",))
cte("ev3", """
  select *, case when type in ('Pass', 'Carry', 'Shot') then nx end as end_x,
            case when type in ('Pass', 'Carry', 'Shot') then ny end as end_y,
    k % 4 = 0 as under_pressure,
    case when type = 'Pass' and k % 13 = 0 then 'SETP' when type = 'Pass' and k % 7 = 0 then 'CROSS'
         when type = 'Pass' and k % 11 = 0 then 'THROUGH'
         when type = 'Pass' and abs(ny - y) >= 30 and abs(nx - x) < 20 then 'SWITCH'
         when type = 'Pass' then 'PASS' when type = 'Carry' then 'CARRY'
         when type = 'Dribble' then 'DRIB'
         when type = 'Shot' then 'SHOT' else 'RECV' end as action,
    greatest(0, least(2, cast(floor(x / 40) as int))) as bi,
    case when y < 16 then 'L' when y < 32 then 'LI' when y < 48 then 'C'
         when y < 64 then 'RI' else 'R' end as channel
  from ev2""", ("ev2",))
cte("ev", """
  select * exclude (nx, ny, bi, channel),
    concat(case bi when 0 then 'D' when 1 then 'M' else 'F' end, '-', channel) as zone,
    concat(action, '@', case bi when 0 then 'D' when 1 then 'M' else 'F' end, '-', channel,
      case when action <> 'SHOT' and end_x is not null and (end_x - x >= 12
           or greatest(0, least(2, cast(floor(end_x / 40) as int))) > bi) then '+' else '' end,
      case when action <> 'SHOT' and end_x >= 102 and end_y between 18 and 62 then '>' else '' end,
      case when under_pressure then '^' else '' end) as token,
    case when type = 'Shot' then value / 600 end as provider_xg,
    type = 'Shot' and value >= 100 as is_goal
  from ev3""", ("ev3",))
cte("matches", """
  select user_id as match_id, user_id % 5 as competition_id, user_id % 2 as season_id,
    concat('C', user_id % 5) as competition, concat('S', user_id % 2) as season,
    cast(min(ts) as date) as match_date, concat('T', user_id % 10) as home_team,
    concat('T', (user_id + 1) % 10) as away_team, user_id % 3 = 0 as has_360
  from events group by user_id""")
cte("poss0", """
  select match_id, possession, arg_min(possession_team, idx) as team,
    arg_min(play_pattern, idx) as play_pattern, min(idx) as start_idx, max(idx) as end_idx,
    greatest(arg_max(minute * 60 + second, idx) - arg_min(minute * 60 + second, idx), 0)::double
      as duration_s,
    string_agg(token, ' ' order by idx) filter (where team = possession_team) as token_string,
    string_agg(zone, ' ' order by idx) filter (where team = possession_team) as zone_path,
    count(*) filter (where team = possession_team) as n_events,
    coalesce(bool_or(type = 'Shot') filter (where team = possession_team), false) as ended_in_shot,
    coalesce(bool_or(is_goal) filter (where team = possession_team), false) as ended_in_goal,
    coalesce(sum(provider_xg) filter (where team = possession_team), 0.0) as xg_sum
  from ev group by match_id, possession""", ("ev",))
cte("poss", """
  select concat(p.match_id, ':', p.possession) as uid, p.*,
    split_part(zone_path, ' ', 1) as start_zone, split_part(zone_path, ' ', -1) as end_zone,
    m.away_team as opponent, m.competition, m.season
  from poss0 p join matches m using (match_id) where n_events >= 3""", ("poss0", "matches"))
cte("shots0", """
  select event_id, match_id, possession, idx, minute, period, team, player, x, y, play_pattern,
    is_goal, provider_xg, under_pressure, k, value,
    sqrt((120 - x) * (120 - x) + (40 - y) * (40 - y)) as distance,
    case k % 3 when 0 then 'Right Foot' when 1 then 'Left Foot' else 'Head' end as body_part,
    case when k % 6 = 0 then 'Volley' else 'Normal' end as technique,
    case when k % 17 = 0 then 'Penalty' else 'Open Play' end as shot_type, k % 8 = 0 as first_time,
    sqrt((120 - x) * (120 - x) + (36 - y) * (36 - y)) as pa,
    sqrt((120 - x) * (120 - x) + (44 - y) * (44 - y)) as pb,
    case when k % 9 <> 0 then list_transform(range(1, 6), lambda i:
      {'px': ((k * 7 + i * 13) % 120)::double, 'py': ((k * 3 + i * 17) % 80)::double,
       'teammate': i % 2 = 0, 'keeper': i = 5}) end as ff
  from ev where type = 'Shot'""", ("ev",))
cte("shots1", """
  select *, case when pa = 0 or pb = 0 then 0.0
    else acos(greatest(-1.0, least(1.0, (pa * pa + pb * pb - 64) / (2 * pa * pb)))) end as angle,
    list_filter(ff, lambda p: not p.teammate and not p.keeper) as opp,
    list_filter(ff, lambda p: not p.teammate and p.keeper)[-1] as gk
  from shots0""", ("shots0",))
cte("shots", """
  select s.*, m.competition_id, m.season_id,
    case when ff is not null then len(list_filter(opp, lambda p:
      not (least((p.px - 120) * (y - 36) - (x - 120) * (p.py - 36),
                 (p.px - 120) * (36 - 44) - (120 - 120) * (p.py - 44),
                 (p.px - x) * (44 - y) - (120 - x) * (p.py - y)) < 0
       and greatest((p.px - 120) * (y - 36) - (x - 120) * (p.py - 36),
                    (p.px - 120) * (36 - 44) - (120 - 120) * (p.py - 44),
                    (p.px - x) * (44 - y) - (120 - x) * (p.py - y)) > 0))) end as n_def_in_cone,
    list_min(list_transform(opp, lambda p: sqrt((p.px - x) * (p.px - x) + (p.py - y) * (p.py - y))))
      as dist_nearest_def,
    sqrt((120 - gk.px) * (120 - gk.px) + (40 - gk.py) * (40 - gk.py)) as gk_dist_to_goal,
    120 - gk.px as gk_off_line
  from shots1 s join matches m using (match_id)""", ("shots1", "matches"))
