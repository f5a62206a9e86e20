"""Queries on result pages, cited summaries, details and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldseq.operators import notes, results
from fieldseq.plans import jobs
from fieldseq.plans.base import (cte, events, matches, possessions, query, r6, shots,
                                 stored_possessions, table,
                                 with_sql)
from fieldseq.plans.eval_set import query_table
from fieldseq.plans.search_queries import (EVAL, SHAPE_FILTERS, SHAPES, drawings, team_seeds,
                                           token_index)

# A fixed logistic of distance and angle stands for the trained model where a
# result must be comparable across engines.
MODEL_SQL = """case when shot_type = 'Penalty' or distance is null or angle is null then null
    else 1 / (1 + exp(0.9::double + 0.045::double * distance - 1.1::double * angle)) end"""
cte("scored", f"select *, {MODEL_SQL} as my_xg from shots", ("shots",))
cte("totals", """select match_id, possession, sum(my_xg) as my_xg_sum from scored
    group by match_id, possession""", ("scored",))


def scored_shots(spark, sf_dir):
    logit = F.lit(0.9) + 0.045 * F.col("distance") - 1.1 * F.col("angle")
    why = results.declined(F.col("shot_type"), F.col("distance"), F.col("angle"))
    return shots(spark, sf_dir).withColumn(
        "my_xg", F.when(why.isNull(), 1 / (1 + F.exp(logit))))


def search_job_tables(spark, sf_dir):
    """Sparse search job over the evaluation queries."""
    items = stored_possessions(spark, sf_dir)
    return jobs.search(query_table(spark, EVAL), items, token_index(items),
                       shots=scored_shots(spark, sf_dir))


cte("page", """select s.qid, s.rank, s.score, p.*, t.my_xg_sum from sparse_top s
    join poss p using (uid) left join totals t using (match_id, possession) where s.rank < 20""",
    ("sparse_top", "poss", "totals"))


def _page_columns(df):
    return (df.withColumn("score", r6("score")).withColumn("xg_sum", r6("xg_sum"))
            .withColumn("my_xg_sum", r6("my_xg_sum"))
            .withColumn("n_events", F.col("n_events").cast("bigint")))


@query("search_job", with_sql(("page",), """
select qid, rank, round(1.0::double / (61 + rank), 6) as score, uid, match_id, team, opponent, competition, season,
  play_pattern, zone_path, token_string, n_events, duration_s, ended_in_shot, ended_in_goal,
  round(xg_sum, 6) as xg_sum, round(my_xg_sum, 6) as my_xg_sum from page"""))
def search_job(spark, sf_dir):
    return _page_columns(search_job_tables(spark, sf_dir)["results"])


def claim_ctes(p: str, page: str, given: str) -> None:
    """DuckDB twin of the cited summaries: table `{p}_claims`."""
    cte(f"{p}_r", f"""select *, coalesce(my_xg_sum, xg_sum, 0) as xg, count(*) over (partition by qid) as n
        from {page} where rank < 8""", (page,))
    def mode(name: str, expr: str) -> None:
        cte(f"{p}_{name}", f"""select * from (select qid, {expr} as label, count(*) as c, any_value(n) as n,
            count(*) over (partition by qid) as kinds, string_agg(uid, ',' order by rank) as uids,
            row_number() over (partition by qid order by count(*) desc, min(rank)) as o
            from {p}_r where n >= 2 group by qid, {expr}) where o = 1""", (f"{p}_r",))
    mode("team", "team")
    mode("pat", "play_pattern")
    mode("zone", "end_zone")
    cte(f"{p}_all", f"""select qid, 1 as o, 'team' as kind, label, c as support, null::double as value, uids
          from {p}_team where c >= greatest(2, n // 2)
        union all select t.qid, 2, 'teams', t.label, t.kinds, t.c, a.uids from {p}_team t join
          (select qid, string_agg(uid, ',' order by rank) as uids from {p}_r group by qid) a using (qid)
          where not c >= greatest(2, n // 2) and kinds >= 3
        union all select qid, 3, 'pattern', label, c, null, uids from {p}_pat where c >= 2 and c > n // 3
        union all select qid, 4, 'chance', null, count(*), avg(xg), string_agg(uid, ',' order by rank)
          from {p}_r where n >= 2 and ended_in_shot group by qid
        union all select qid, 5, 'shots', null, count(*), avg(xg), string_agg(uid, ',' order by rank)
          from {p}_r where n >= 2 and ended_in_shot group by qid having count(*) >= 2
        union all select qid, 6, 'goals', null, count(*), avg(xg), string_agg(uid, ',' order by rank)
          from {p}_r where n >= 2 and ended_in_goal group by qid
        union all select qid, 7, 'finish', label, c, null, uids from {p}_zone where c >= 2
        union all select qid, 8, 'tempo', case when median(n_events) <= 8 then 'short and direct'
            when median(n_events) >= 20 then 'sustained' else 'moderate' end, count(*), median(n_events),
          string_agg(uid, ',' order by rank) from {p}_r where n >= 2 group by qid
        union all select qid, 9, 'standout', arg_max(team, (xg, -rank)), 1, max(xg),
          arg_max(uid, (xg, -rank)) from {p}_r where n >= 2 group by qid having max(xg) > 0.15""",
        (f"{p}_team", f"{p}_pat", f"{p}_zone"))
    cte(f"{p}_claims", f"""select qid, (row_number() over (partition by qid order by o))::int as claim_no,
        kind, label, support::double as support, value, uids from {p}_all a {given}""", (f"{p}_all",))


_KEEP = """not case kind when 'team' then list_contains(given, 'team')
    when 'teams' then list_contains(given, 'team')
    when 'pattern' then list_contains(given, 'play_pattern')
    when 'chance' then not list_contains(given, 'ended_in_shot')
    when 'shots' then list_contains(given, 'ended_in_shot')
    when 'goals' then list_contains(given, 'ended_in_goal')
    when 'finish' then list_contains(given, 'end_zone') else false end"""
cte("evalgiven", "select qid as gq, given from evalq", ("evalq",))
claim_ctes("nt", "page", f"join evalgiven on gq = qid where {_KEEP}")
_CLAIMS = """select qid, claim_no, kind, label, support, round(value, 6) as value, uids
from {}_claims where claim_no <= 5"""


def _claim_columns(made):
    return made.select("qid", "claim_no", "kind", "label",
                       F.col("support").cast("double").alias("support"),
                       r6("value").alias("value"), F.array_join("uids", ",").alias("uids"))


@query("search_notes", with_sql(("evalgiven", "nt_claims"), _CLAIMS.format("nt")))
def search_notes(spark, sf_dir):
    return _claim_columns(search_job_tables(spark, sf_dir)["notes"])


@query("note_citations", with_sql(("page",), """
select qid, 0 as claim_no, uid from page where false"""))
def note_citations(spark, sf_dir):
    """Claims citing rows outside their page: there must be none."""
    job = search_job_tables(spark, sf_dir)
    return notes.unsupported(job["notes"], job["page"])


cte("shape_page", """select s.qid, s.rank, p.*, t.my_xg_sum from (
    select *, (row_number() over (partition by qid order by coverage desc, n_events desc, uid desc)
      - 1)::int as rank from shape_all) s join poss p using (uid)
    left join totals t using (match_id, possession) where s.rank < 20""",
    ("shape_all", "poss", "totals"))
claim_ctes("sh", "shape_page", "where kind not in ('finish', 'chance') and not "
           "(kind = 'shots' and qid = 's2') and not (kind = 'pattern' and qid = 's6') "
           "or (kind = 'chance' and qid = 's2')")


@query("shape_job", with_sql(("sh_claims",), _CLAIMS.format("sh")))
def shape_job(spark, sf_dir):
    """Cited summary of shape search; the drawing already fixes where moves end."""
    made = jobs.shape(SHAPES, stored_possessions(spark, sf_dir), SHAPE_FILTERS,
                      scored_shots(spark, sf_dir))
    return _claim_columns(made["notes"])


_JOB_PAGE = """select qid, rank, uid, team, opponent, play_pattern, token_string, n_events::bigint as n_events,
  ended_in_shot, round(xg_sum, 6) as xg_sum, round(my_xg_sum, 6) as my_xg_sum from {}_page where rank < 20"""


def _job_columns(made):
    return made.select("qid", "rank", "uid", "team", "opponent", "play_pattern", "token_string",
                       F.col("n_events").cast("bigint").alias("n_events"), "ended_in_shot",
                       r6("xg_sum").alias("xg_sum"), r6("my_xg_sum").alias("my_xg_sum"))


@query("shape_job_page", with_sql(("shape_page",), _JOB_PAGE.format("shape")))
def shape_job_page(spark, sf_dir):
    """Result page of the job for a table of shapes."""
    made = jobs.shape_table(drawings(spark), stored_possessions(spark, sf_dir), scored_shots(spark, sf_dir))
    return _job_columns(made["results"])


cte("sim_page", """select s.qid, s.rank, p.*, t.my_xg_sum from similar_top s join poss p using (uid)
    left join totals t using (match_id, possession)""", ("similar_top", "poss", "totals"))
claim_ctes("sm", "sim_page", "where kind <> 'chance'")


@query("similar_job", with_sql(("sm_claims",), _CLAIMS.format("sm")))
def similar_job(spark, sf_dir):
    items = stored_possessions(spark, sf_dir)
    made = jobs.similar(team_seeds(items), items, token_index(items).shared(),
                        shots=scored_shots(spark, sf_dir))
    return _claim_columns(made["notes"])


@query("similar_job_page", with_sql(("sim_page",), _JOB_PAGE.format("sim")))
def similar_job_page(spark, sf_dir):
    items = stored_possessions(spark, sf_dir)
    made = jobs.similar(team_seeds(items), items, token_index(items).shared(),
                        shots=scored_shots(spark, sf_dir))
    return _job_columns(made["results"])


cte("detail", """select concat(match_id, ':', possession) as uid, event_id, idx, period, minute, second,
    type, team, player, team = possession_team as att,
    case when team = possession_team then x else 120 - x end as x,
    case when team = possession_team then y else 80 - y end as y,
    case when team = possession_team then end_x else 120 - end_x end as end_x,
    case when team = possession_team then end_y else 80 - end_y end as end_y, duration,
    under_pressure, case when team = possession_team then token end as token
  from ev semi join poss using (match_id, possession)""", ("ev", "poss"))


def detailed(spark, sf_dir):
    return results.detail(events(spark, sf_dir), possessions(spark, sf_dir))


@query("possession_detail", with_sql(("detail",), """
select uid, event_id, idx, period, minute, second, type, team, player, att as is_attacking,
  round(x, 6) as x, round(y, 6) as y, round(end_x, 6) as end_x, round(end_y, 6) as end_y,
  round(duration, 6) as duration, under_pressure, token from detail"""))
def possession_detail(spark, sf_dir):
    d = detailed(spark, sf_dir)
    return d.select("uid", "event_id", "idx", "period", "minute", "second", "type", "team", "player",
                    "is_attacking", *[r6(c).alias(c) for c in ("x", "y", "end_x", "end_y", "duration")],
                    "under_pressure", "token")


@query("playback_steps", with_sql(("detail",), """
select uid, event_id, idx, round(x, 6) as x, round(y, 6) as y,
  round(coalesce(end_x, lead(x) over w, x), 6) as to_x,
  round(coalesce(end_y, lead(y) over w, y), 6) as to_y,
  greatest(120, floor(duration * 1000 + 0.5::double)::int) as ms, coalesce(token, type) as label,
  att as is_attacking, under_pressure, type = 'Shot' as is_shot
from detail window w as (partition by uid order by idx)"""))
def playback_steps(spark, sf_dir):
    p = results.playback(detailed(spark, sf_dir))
    return p.select("uid", "event_id", "idx", *[r6(c).alias(c) for c in ("x", "y", "to_x", "to_y")],
                    "ms", "label", "is_attacking", "under_pressure", "is_shot")


@query("last_freeze_frame", with_sql(("detail", "shots"), """
select uid, i::int - 1 as i, ff[i].px as x, ff[i].py as y, ff[i].teammate as teammate,
  ff[i].keeper as keeper
from (select d.uid, arg_max(s.ff, d.idx) as ff from detail d join shots s using (event_id)
      where s.ff is not null group by d.uid), unnest(range(1, 6)) t(i)"""))
def last_freeze_frame(spark, sf_dir):
    return results.last_frame(detailed(spark, sf_dir), shots(spark, sf_dir))


@query("possession_timeline", with_sql(("detail", "scored"), """
select d.uid, d.event_id, d.idx, d.type, d.att as is_attacking, round(s.distance, 6) as distance,
  s.body_part, round(s.my_xg, 6) as my_xg from detail d left join scored s using (event_id)"""))
def possession_timeline(spark, sf_dir):
    """Events of all possessions in one table with their shots, where they are shots."""
    t = results.timeline(detailed(spark, sf_dir), scored_shots(spark, sf_dir), ("distance", "body_part", "my_xg"))
    return t.select("uid", "event_id", "idx", "type", "is_attacking", r6("distance").alias("distance"),
                    "body_part", r6("my_xg").alias("my_xg"))


@query("possession_shots", with_sql(("detail", "scored"), """
select d.uid, d.event_id, d.idx, d.minute, round(s.my_xg, 6) as my_xg,
  round(s.provider_xg, 6) as provider_xg from detail d join scored s using (event_id)"""))
def possession_shots(spark, sf_dir):
    s = results.shots_of(detailed(spark, sf_dir), scored_shots(spark, sf_dir))
    return s.select("uid", "event_id", "idx", "minute", r6("my_xg").alias("my_xg"),
                    r6("provider_xg").alias("provider_xg"))


@query("shot_comparison", with_sql(("scored",), """
select event_id, match_id, player, minute, team, shot_type, body_part, is_goal,
  round(provider_xg, 6) as provider_xg, round(my_xg, 6) as my_xg,
  case when my_xg is null then case when shot_type = 'Penalty'
    then 'penalty, not modelled' else 'position of the shot unknown' end end as my_xg_note,
  concat(competition_id, ':', season_id) in ('1:0', '2:1') as in_holdout,
  round(gk_off_line, 6) as gk_off_line from scored"""))
def shot_comparison(spark, sf_dir):
    group = F.concat_ws(":", "competition_id", "season_id")
    s = results.shot_comparison(scored_shots(spark, sf_dir), events(spark, sf_dir),
                                group.isin("1:0", "2:1"))
    return s.select("event_id", "match_id", "player", "minute", "team", "shot_type", "body_part",
                    "is_goal", r6("provider_xg").alias("provider_xg"), r6("my_xg").alias("my_xg"),
                    "my_xg_note", "in_holdout", r6("gk_off_line").alias("gk_off_line"))


@query("shot_panel", with_sql(("scored",), """
select match_id, possession, arg_max(event_id, idx) as last_event_id, count(*) - 1 as n_earlier,
  count(my_xg) as n_scored, round(sum(my_xg), 6) as total,
  round(list(my_xg order by idx)[-1], 6) as last_my_xg,
  round(list(my_xg order by idx)[-1] - list(provider_xg order by idx)[-1], 6) as gap
from scored group by match_id, possession"""))
def shot_panel(spark, sf_dir):
    p = results.shot_panel(scored_shots(spark, sf_dir))
    return p.select("match_id", "possession", "last_event_id", "n_earlier", "n_scored",
                    r6("total").alias("total"), r6("last_my_xg").alias("last_my_xg"),
                    r6("gap").alias("gap"))


@query("model_totals", with_sql(("poss", "totals"), """
select uid, round(my_xg_sum, 6) as my_xg_sum from poss left join totals using (match_id, possession)"""))
def model_totals(spark, sf_dir):
    rows = possessions(spark, sf_dir).select("uid", "match_id", "possession")
    return results.attach_model_xg(rows, scored_shots(spark, sf_dir)) \
        .select("uid", r6("my_xg_sum").alias("my_xg_sum"))


@query("facets", with_sql(("poss",), """
select 'competition' as field, competition as value, count(*) as n from poss group by all
union all select 'team', team, count(*) from poss group by all
union all select 'play_pattern', play_pattern, count(*) from poss group by all"""))
def facets(spark, sf_dir):
    return results.facets(possessions(spark, sf_dir))


@query("team_ranking", with_sql(("poss",), "select team, count(*) as n from poss group by team"))
def team_ranking(spark, sf_dir):
    counted = possessions(spark, sf_dir).groupBy("team").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "team")


@query("corpus_counts", with_sql(("poss",), """
select 'possessions' as "table", count(*) as n from poss union all select 'matches', count(*) from matches
union all select 'events', count(*) from events"""))
def corpus_counts(spark, sf_dir):
    return results.corpus_counts(possessions=possessions(spark, sf_dir),
                                 matches=matches(spark, sf_dir),
                                 events=table(spark, sf_dir, "events"))
