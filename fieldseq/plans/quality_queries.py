"""Queries on inventory, sampling, export sizes and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldseq.operators import dense, quality
from fieldseq.plans.base import cte, events, matches, possessions, query, r6, shots, table, with_sql
from fieldseq.sources import tables


@query("match_inventory", with_sql(("matches",), """
select competition, season, count(*) as matches, count(*) filter (where has_360) as matches_360,
  any_value(teams) as teams, min(match_date) as first, max(match_date) as last
from matches join (select competition, season, count(distinct team) as teams from (
    select competition, season, unnest([home_team, away_team]) as team from matches)
  group by competition, season) using (competition, season) group by competition, season
union all select null, null, count(*), count(*) filter (where has_360),
  (select count(distinct team) from (select unnest([home_team, away_team]) as team from matches)),
  min(match_date), max(match_date) from matches"""))
def match_inventory(spark, sf_dir):
    return quality.inventory(matches(spark, sf_dir))


@query("match_totals", with_sql(("matches",), """
select case when competition_id % 2 = 0 then 'female' else 'male' end as gender,
  count(*) as matches, count(*) filter (where has_360) as matches_360 from matches group by 1"""))
def match_totals(spark, sf_dir):
    m = matches(spark, sf_dir)
    comps = m.select("competition_id", "season_id",
                     F.when(F.col("competition_id") % 2 == 0, "female").otherwise("male")
                     .alias("gender"))
    return quality.totals_by(m, comps, "gender")


@query("best_per_flag", with_sql(("matches",), """
select competition, season, matches, matches_360, flagged, rank from (
  select *, (row_number() over (partition by flagged order by
      case when flagged then matches_360 else matches end desc, competition, season) - 1)::int as rank
  from (select competition, season, count(*) as matches, count(*) filter (where has_360) as matches_360,
      count(*) filter (where has_360) > 0 as flagged from matches group by all)) where rank < 2"""))
def best_per_flag(spark, sf_dir):
    return quality.best_per_flag(matches(spark, sf_dir))


@query("busiest_match", with_sql(("ev",), """
select match_id, count(*) as n from ev where type = 'Shot' group by match_id
order by n desc, match_id limit 1"""))
def busiest_match(spark, sf_dir):
    return quality.busiest(events(spark, sf_dir).filter(F.col("type") == "Shot"), "match_id")


@query("shot_range", with_sql(("ev",), """
select match_id, count(*) as n, round(min(x), 6) as min_x, round(max(x), 6) as max_x,
  round(min(y), 6) as min_y, round(max(y), 6) as max_y from ev where type = 'Shot' and match_id = (
    select match_id from ev where type = 'Shot' group by match_id order by count(*) desc, match_id limit 1)
group by match_id"""))
def shot_range(spark, sf_dir):
    s = quality.shot_range(events(spark, sf_dir).filter(F.col("type") == "Shot"))
    return s.select("match_id", "n", *[r6(c).alias(c) for c in s.columns[2:]])


@query("event_type_top", with_sql(("ev",), """
select type, count(*) as n from ev group by type order by n desc, type limit 25"""))
def event_type_top(spark, sf_dir):
    return quality.type_frequency(events(spark, sf_dir))


@query("coordinate_range", with_sql(("ev",), """
select round(min(x), 6) as min_x, round(max(x), 6) as max_x, round(min(y), 6) as min_y,
  round(max(y), 6) as max_y, count(*) as n, max(x) <= 120.5 and max(y) <= 80.5 as passes from ev"""))
def coordinate_range(spark, sf_dir):
    c = quality.coordinate_range(events(spark, sf_dir))
    return c.select(*[r6(n).alias(n) for n in c.columns[:4]], "n", "passes")


@query("attack_direction", with_sql(("ev",), """
select period, count(*) as n, round(avg((x > 60)::int), 6) as forward, avg((x > 60)::int) > 0.97 as passes
from ev where type = 'Shot' group by rollup (period)"""))
def attack_direction(spark, sf_dir):
    shot_events = events(spark, sf_dir).filter(F.col("type") == "Shot")
    return quality.attack_direction(shot_events).withColumn("forward", r6("forward"))


@query("missing_groups", with_sql(("ev",), """
select count(*) as n, count(*) filter (where possession is null) as no_possession,
  count(*) filter (where possession_team is null) as no_team from ev"""))
def missing_groups(spark, sf_dir):
    return quality.missing_groups(events(spark, sf_dir))


@query("shot_coverage", with_sql(("shots",), """
select count(*) as n, round(avg((provider_xg is not null)::int), 6) as with_xg,
  round(avg((ff is not null)::int), 6) as with_frame from shots"""))
def shot_coverage(spark, sf_dir):
    c = quality.shot_coverage(shots(spark, sf_dir))
    return c.select("n", r6("with_xg").alias("with_xg"), r6("with_frame").alias("with_frame"))


@query("companion_presence", with_sql(("matches",), """
select has_360, count(*) as matches, count(l.doc_id) as present
from matches left join (select distinct doc_id from labels) l on l.doc_id = match_id group by has_360"""))
def companion_presence(spark, sf_dir):
    """Label ids stand for the listing of companion files."""
    there = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("match_id"))
    return quality.companion_presence(matches(spark, sf_dir), there)


@query("order_disagreement", with_sql(("ev",), """
select match_id, bool_or(coalesce(nxt < t, false)) as disagrees from (
  select match_id, (period * 100000 + minute) as t,
    lead(period * 100000 + minute) over (partition by match_id order by idx) as nxt from ev)
group by match_id"""))
def order_disagreement(spark, sf_dir):
    return quality.order_disagreement(events(spark, sf_dir), ["period", "minute"], width=1 << 20)


@query("clock_restarts", with_sql(("ev",), """
select match_id, count(*) as periods, count(*) > 1 and bool_and(starts_with(first, '0')) as restarts
from (select match_id, period, arg_min(lpad(((minute // 60) % 24)::varchar, 2, '0'), idx) as first
  from ev group by match_id, period) group by match_id"""))
def clock_restarts(spark, sf_dir):
    hour = F.lpad((F.floor(F.col("minute") / 60) % 24).cast("string"), 2, "0")
    return quality.clock_restarts(events(spark, sf_dir).withColumn("timestamp", hour),
                                  "timestamp", "0")


@query("earliest_n_per_group", """
select o_custkey, o_orderkey, o_orderdate, rank from (
  select o_custkey, o_orderkey, o_orderdate, (row_number() over
    (partition by o_custkey order by o_orderdate, o_orderkey) - 1)::int as rank from orders)
where rank < 3""")
def earliest_n_per_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return quality.earliest_per_group(orders, ["o_custkey"], "o_orderdate", "o_orderkey", 3)


@query("sample_per_group", """
select c_nationkey, c_custkey, draw from (select c_nationkey, c_custkey, (row_number() over
  (partition by c_nationkey order by md5(concat(c_custkey, ':7')), c_custkey) - 1)::int as draw
  from customer) where draw < 3""")
def sample_per_group(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return quality.sample_per_group(customers, ["c_nationkey"], "c_custkey", 3, 7)


@query("recent_subset", with_sql(("poss",), """
select uid, match_id from poss where match_id in (
  select match_id from matches order by match_date desc nulls last, match_id limit 20)"""))
def recent_subset(spark, sf_dir):
    ids = tables.most_recent(matches(spark, sf_dir), 20)
    return tables.subset(possessions(spark, sf_dir).select("uid", "match_id"), ids)


cte("recent", """select match_id from matches order by match_date desc nulls last, match_id
    limit 20""", ("matches",))


@query("export_sizes", with_sql(("poss", "ev", "recent"), """
select "table", count(*) as n from (select 'matches' as "table" from matches semi join recent using (match_id)
  union all select 'events' from ev semi join recent using (match_id)
  union all select 'possessions' from poss semi join recent using (match_id)) group by rollup ("table")"""))
def export_sizes(spark, sf_dir):
    m = matches(spark, sf_dir)
    return tables.export_sizes({"matches": m, "events": events(spark, sf_dir),
                                "possessions": possessions(spark, sf_dir)},
                               tables.most_recent(m, 20))


@query("vector_update", """
select doc_id, lang, len(embedding)::double as width from documents left join embeddings on vec_id = doc_id""")
def vector_update(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    joined = dense.with_vectors(docs, vectors, "doc_id")
    return joined.select("doc_id", "lang", F.when(F.col("embedding").isNotNull(),
                                                  F.size("embedding")).cast("double").alias("width"))
