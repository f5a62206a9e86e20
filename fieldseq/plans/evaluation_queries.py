"""Queries on rubrics, retrieval metrics, pools and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldseq.operators import dense, filters, fuse, metrics, rubrics
from fieldseq.operators.possessions import zone_line
from fieldseq.plans.base import (cte, events, possessions, query, r6, stored_possessions, table,
                                 with_sql)
from fieldseq.plans.eval_set import FILTER_DOMINATED, query_table
from fieldseq.operators.filters import Filters
from fieldseq.plans import jobs
from fieldseq.plans.search_queries import (EVAL, eval_filters, hint_tokens, sql_predicate,
                                           team_seeds, token_index)
from fieldseq.spec import ZONES

# --- the rules in DuckDB SQL ---------------------------------------------------------------
_LS = "regexp_extract(token_string, '^(?:.* )?SHOT@([DMF]-[LRCI]+)', 1)"


def _m(line: str, *patterns: str) -> str:
    return " and ".join(f"regexp_matches({line}, '{p}')" for p in patterns)


def sql_rules() -> dict[str, str]:
    ts, zp = "token_string", "zone_path"
    third = _m(ts, rubrics.FINAL_THIRD)
    rules = {q: _m(ts, p) for q, p in rubrics.TOKEN_PATTERNS.items()}
    rules |= {q: _m(ts, *p) for q, p in rubrics.ALL_TOKEN_PATTERNS.items()}
    rules |= {q: _m(zp, *p) for q, p in rubrics.ZONE_PATTERNS.items()}
    rules |= {
        "q04": "ended_in_shot and n_events <= 25",
        "q12": f"{third} and n_events <= 25",
        "q14": f"starts_with({_LS}, 'M-')",
        "q15": f"{_m(zp, rubrics.WIDE_RIGHT)} and {_m(ts, rubrics.SQUARED)}",
        "q18": f"({_m(zp, rubrics.RETREAT_LEFT)} or {_m(zp, rubrics.RETREAT_RIGHT)})",
        "q19": f"{_m(zp, rubrics.CENTRAL_RUN)} and {third}",
        "q20": f"{_LS} = 'F-C'",
        "q21": "length(token_string) - length(replace(token_string, '^', '')) >= 4 and "
               + _m(ts, "^[A-Z]+@D-", "@[MF]-"),
        "q24": "len(list_filter(string_split(token_string, ' '), "
               "lambda t: starts_with(t, 'LOSS') or starts_with(t, 'DUEL'))) <= 2",
        "q26": f"{_m(zp, rubrics.DOWN_RIGHT)} and {_LS} = 'F-RI'",
        "q29": "len(list_filter(string_split(token_string, ' '), lambda t: regexp_matches(t, "
               f"'{rubrics.INSIDE_LEFT_PASS}'))) >= 2 and {third}",
    }
    return dict(sorted(rules.items()))


RULES = sql_rules()
VERDICT = "case qid " + " ".join(f"when '{q}' then ({r})::int" for q, r in RULES.items()) + " end"


@query("rubric_matrix", with_sql(("poss",), "select uid, " + ", ".join(
    f"({r})::int as {q}" for q, r in RULES.items()) + " from poss"))
def rubric_matrix(spark, sf_dir):
    return rubrics.matrix(possessions(spark, sf_dir))


@query("rubric_statistics", with_sql(("poss",), """
select qid, n_filtered, n_relevant,
  round(case when n_filtered > 0 then n_relevant / n_filtered::double else 0 end, 6) as rate,
  coalesce(n_relevant / nullif(n_filtered, 0)::double, 0) >= 0.9 as dominated from (""" + " union all ".join(
    f"select '{q}' as qid, count(*) filter (where {sql_predicate(f)}) as n_filtered, "
    f"count(*) filter (where {sql_predicate(f)} and {RULES[q]}) as n_relevant from poss"
    for q, (_, f, _h) in EVAL.items()) + ")"))
def rubric_statistics(spark, sf_dir):
    s = metrics.rubric_statistics(possessions(spark, sf_dir), eval_filters())
    return s.withColumn("rate", r6("rate"))


# --- rankings of the evaluation queries ------------------------------------------------------
_ZONES = "[" + ", ".join(f"'{z}'" for z in ZONES) + "]"


def _profile(path: str) -> str:
    return (f"list_transform({_ZONES}, lambda z: len(list_filter(string_split({path}, ' '), "
            f"lambda p: p = z))::double)")


cte("poss_vec", f"select uid, v, sqrt(list_dot_product(v, v)) as n from "
    f"(select uid, {_profile('zone_path')} as v from poss)", ("poss",))
cte("hint_vec", f"""select qid, v, sqrt(list_dot_product(v, v)) as n from (select qid,
    {_profile("regexp_replace(regexp_replace(hint, '[^ ]*@', '', 'g'), '[+>^]+( |$)', '" + chr(92) + "1', 'g')")}
    as v from evalq)""", ("evalq",))
cte("dense_eval", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select h.qid, p.uid, round(list_dot_product(h.v, p.v) / (h.n * p.n), 9) as score
      from hint_vec h join cand using (qid) join poss_vec p on p.uid = cand.uid)) where rank < 50""",
    ("hint_vec", "poss_vec", "cand"))
cte("fused_eval", """select * from (select *, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select qid, uid, sum(1.0::double / (61 + rank)) as score from
        (select qid, uid, rank from sparse_top union all select qid, uid, rank from dense_eval)
      group by qid, uid)) where rank < 10""", ("sparse_top", "dense_eval"))
cte("eval_pool", """select qid, 'sparse' as ranker, uid, rank from sparse_top where rank < 10
    union all select qid, 'dense', uid, rank from dense_eval where rank < 10
    union all select qid, 'fused', uid, rank from fused_eval""", ("fused_eval",))
cte("eval_judged", f"select e.*, {VERDICT} as label from eval_pool e join poss p using (uid)",
    ("eval_pool", "poss"))
cte("eval_metrics", """select qid, ranker, coalesce(p5, 0) as p5, coalesce(p10, 0) as p10,
    coalesce(mrr, 0) as mrr from (select qid, ranker from evalq,
      (values ('sparse'), ('dense'), ('fused')) r(ranker)) left join (select qid, ranker,
        sum(label) filter (where rank < 5) / 5.0::double as p5, sum(label) / 10.0::double as p10,
        1.0::double / (min(rank) filter (where label = 1) + 1) as mrr
      from eval_judged group by qid, ranker) using (qid, ranker)""", ("eval_judged", "evalq"))

RANKERS = ("sparse", "dense", "fused")


def eval_rankings(spark, sf_dir, limit=10):
    """Sparse, zone-profile and fused rankings of the evaluation queries."""
    items = stored_possessions(spark, sf_dir)
    asked = query_table(spark, EVAL).withColumn(
        "embedding", dense.zone_profile(zone_line(F.col("hint"))))
    vectors = items.select("uid", dense.zone_profile(F.col("zone_path")).alias("embedding"))
    found = fuse.hybrid(asked, items, token_index(items), hint_tokens(), vectors, limit,
                        shared=True)
    return items, asked, {ranker: found[ranker] for ranker in RANKERS}


# --- hybrid search with filters from a table, parsed and explicit ----------------------------
EXPLICIT = {q: Filters(min_events=4) for q in EVAL if int(q[1:]) % 2 == 0}
cte("hj_cand", " union all ".join(
    f"select '{q}' as qid, uid from poss where "
    f"{sql_predicate(f.overridden_by(EXPLICIT.get(q, Filters())))}"
    for q, (_, f, _h) in EVAL.items()), ("poss",))
for _name, _source, _needs in (
        ("hj_sparse", "sparse_all semi join hj_cand using (qid, uid)", ("sparse_all", "hj_cand")),
        ("hj_dense", """(select h.qid, p.uid, round(list_dot_product(h.v, p.v) / (h.n * p.n), 9) as score
          from hint_vec h join hj_cand c using (qid) join poss_vec p on p.uid = c.uid)""",
         ("hint_vec", "poss_vec", "hj_cand"))):
    cte(_name, f"""select * from (select qid, uid, score, (row_number() over
        (partition by qid order by score desc, uid) - 1)::int as rank from {_source}) where rank < 50""",
        _needs)
cte("hj_fused", """select * from (select *, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select qid, uid, sum(1.0::double / (61 + rank)) as score from
        (select qid, uid, rank from hj_sparse union all select qid, uid, rank from hj_dense)
      group by qid, uid)) where rank < 20""", ("hj_sparse", "hj_dense"))


def hybrid_job_tables(spark, sf_dir):
    """Search job with vectors; explicitly given filters win over those of the query set."""
    items = stored_possessions(spark, sf_dir)
    given = query_table(spark, {q: ("", f, "") for q, f in EXPLICIT.items()}).select(
        "qid", F.col("filters").alias("_given"))
    asked = query_table(spark, EVAL).join(given, "qid", "left").select(
        "qid", "text", "hint", filters.merged(F.col("filters"), F.col("_given")).alias("filters"),
        dense.zone_profile(zone_line(F.col("hint"))).alias("embedding"))
    vectors = items.select("uid", dense.zone_profile(F.col("zone_path")).alias("embedding"))
    return jobs.search(asked, items, token_index(items), vectors)


@query("hybrid_job", with_sql(("hj_fused", "poss"), """
select f.qid, f.rank, f.uid, round(f.score, 6) as score, p.team, p.start_zone, p.end_zone,
  p.n_events::bigint as n_events, p.ended_in_shot from hj_fused f join poss p using (uid)"""))
def hybrid_job(spark, sf_dir):
    page = hybrid_job_tables(spark, sf_dir)["page"]
    return page.select("qid", "rank", "uid", r6("score").alias("score"), "team",
                       F.substring_index("zone_path", " ", 1).alias("start_zone"),
                       F.substring_index("zone_path", " ", -1).alias("end_zone"),
                       F.col("n_events").cast("bigint").alias("n_events"), "ended_in_shot")


@query("hybrid_candidates", with_sql(("hj_cand", "evalq"), """
select qid, count(uid) as n_candidates from evalq left join hj_cand using (qid) group by qid"""))
def hybrid_candidates(spark, sf_dir):
    return hybrid_job_tables(spark, sf_dir)["counts"]


cte("sf_cand", "select s.qid, p.uid from seeds s, poss p where p.play_pattern = 'From Corner' "
    "and p.ended_in_shot", ("seeds", "poss"))
cte("sf_sparse", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select s.qid, p.uid, round(sum(p.weight * q.weight), 9) as score
      from seeds s join pt_post q on q.uid = s.seed join pt_post p on p.gram = q.gram
      where p.uid <> s.seed group by s.qid, p.uid) semi join sf_cand using (qid, uid)
    where score > 0) where rank < 50""", ("seeds", "pt_post", "sf_cand"))
cte("sf_dense", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select s.qid, v.uid, round(list_dot_product(o.v, v.v) / (o.n * v.n), 9) as score
      from seeds s join poss_vec o on o.uid = s.seed join sf_cand c on c.qid = s.qid
        join poss_vec v on v.uid = c.uid where v.uid <> s.seed)) where rank < 50""",
    ("seeds", "poss_vec", "sf_cand"))


@query("similar_filtered", with_sql(("sf_sparse", "sf_dense"), """
select qid, uid, rank, round(score, 6) as score from (
  select *, (row_number() over (partition by qid order by score desc, uid) - 1)::int as rank from (
    select qid, uid, sum(1.0::double / (61 + rank)) as score from
      (select qid, uid, rank from sf_sparse union all select qid, uid, rank from sf_dense)
    group by qid, uid)) where rank < 20"""))
def similar_filtered(spark, sf_dir):
    """More like each team's longest possession, among shots from corners only."""
    items = stored_possessions(spark, sf_dir)
    wanted = query_table(spark, {"all": ("", Filters(play_pattern="From Corner", ended_in_shot=True), "")})
    seeds = team_seeds(items).join(wanted.select("filters"))
    vectors = items.select("uid", dense.zone_profile(F.col("zone_path")).alias("embedding"))
    found = fuse.similar(seeds, token_index(items).shared(), vectors, items=items)["fused"]
    return found.withColumn("score", r6("score"))


def judged_pool(spark, sf_dir):
    items, asked, found = eval_rankings(spark, sf_dir)
    pool = fuse.pooled(found).filter(F.col("rank") < 10)
    rows = pool.join(items.select("uid", "token_string", "zone_path", "n_events",
                                  "ended_in_shot"), "uid")
    return asked, rows.withColumn("label", rubrics.judged(F.col("qid")))


@query("dense_filtered", with_sql(("dense_eval",), """
select qid, uid, rank, round(score, 6) as score from dense_eval"""))
def dense_filtered(spark, sf_dir):
    _, _, found = eval_rankings(spark, sf_dir)
    return found["dense"].withColumn("score", r6("score"))


@query("ranking_metrics", with_sql(("eval_metrics",), """
select qid, ranker, round(p5, 6) as p5, round(p10, 6) as p10, round(mrr, 6) as mrr from eval_metrics"""))
def ranking_metrics(spark, sf_dir):
    asked, judged = judged_pool(spark, sf_dir)
    m = metrics.ranking_metrics(judged, asked, RANKERS)
    return m.select("qid", "ranker", r6("p5").alias("p5"), r6("p10").alias("p10"),
                    r6("mrr").alias("mrr"))


_DOMINATED = ", ".join(f"'{q}'" for q in FILTER_DOMINATED)


@query("retrieval_report", with_sql(("eval_metrics",), f"""
select subset, ranker, count(*) as n_queries, round(avg(p5), 6) as p5, round(avg(p10), 6) as p10,
  round(avg(mrr), 6) as mrr from (
    select 'all' as subset, * from eval_metrics
    union all select 'discriminating', * from eval_metrics where qid not in ({_DOMINATED}))
group by subset, ranker"""))
def retrieval_report(spark, sf_dir):
    asked, judged = judged_pool(spark, sf_dir)
    m = metrics.ranking_metrics(judged, asked, RANKERS)
    means = metrics.macro_means(m, {"all": F.lit(True),
                                    "discriminating": ~F.col("qid").isin(*FILTER_DOMINATED)})
    return means.select("subset", "ranker", "n_queries", r6("p5").alias("p5"),
                        r6("p10").alias("p10"), r6("mrr").alias("mrr"))


@query("ranker_overlap", with_sql(("eval_pool",), """
select qid, count(*) filter (where s and d) as shared from (
  select qid, uid, bool_or(ranker = 'sparse') as s, bool_or(ranker = 'dense') as d
  from eval_pool group by qid, uid) group by qid"""))
def ranker_overlap(spark, sf_dir):
    _, _, found = eval_rankings(spark, sf_dir)
    return metrics.ranker_overlap(fuse.pooled(found), "sparse", "dense")


@query("length_diagnostic", with_sql(("sparse_top", "poss"), """
select median(n_events)::double as median_top,
  (select median(n_events)::double from poss) as median_corpus
from sparse_top join poss using (uid) where rank < 5"""))
def length_diagnostic(spark, sf_dir):
    from fieldseq.plans.search_queries import eval_sparse
    items = stored_possessions(spark, sf_dir)
    return metrics.length_diagnostic(eval_sparse(spark, items), items)


@query("judging_pool", with_sql(("eval_pool",), """
select qid, uid, (row_number() over (partition by qid order by ranker_no, rank, uid) - 1)::int
  as position from (
    select qid, uid, min(ranker_no) as ranker_no, arg_min(rank, ranker_no) as rank from (
      select *, case ranker when 'sparse' then 0 when 'dense' then 1 else 2 end as ranker_no
      from eval_pool) group by qid, uid)
where (qid, uid) not in (select (qid, uid) from eval_pool where ranker = 'fused' and rank = 0)"""))
def judging_pool(spark, sf_dir):
    """Pool of the three rankings; each query's best fused hit counts as judged."""
    _, _, found = eval_rankings(spark, sf_dir)
    number = F.when(F.col("ranker") == "sparse", 0).when(F.col("ranker") == "dense", 1).otherwise(2)
    pool = fuse.pooled(found).withColumn("ranker_no", number)
    judged = found["fused"].filter(F.col("rank") == 0)
    return metrics.judging_pool(pool, judged).select("qid", "uid", "position")


@query("audit_sample", with_sql(("sparse_top", "dense_eval"), """
select qid, uid, position, blind_order from (
  select *, coalesce(sum(n) over (order by md5(concat(qid, ':11')), qid
      rows between unbounded preceding and 1 preceding), 0) as before
  from (select qid, count(*) as n from audit_some group by qid)) join audit_some using (qid)
where before + blind_order < 40""".replace("audit_some", """(
  select * from (select qid, uid,
    (row_number() over (partition by qid order by ranker_no, rank, uid) - 1)::int as position,
    (row_number() over (partition by qid order by md5(concat(uid, ':11')), uid) - 1)::int
      as blind_order
  from (select qid, uid, min(ranker_no) as ranker_no, arg_min(rank, ranker_no) as rank from (
    select qid, uid, rank, 0 as ranker_no from sparse_top where rank < 6
    union all select qid, uid, rank, 1 from dense_eval where rank < 6) group by qid, uid))
  where blind_order < 5)""")))
def audit_sample(spark, sf_dir):
    """Seeded blind sample: up to five items per query, forty overall."""
    _, _, found = eval_rankings(spark, sf_dir)
    two = {k: found[k].filter(F.col("rank") < 6) for k in ("sparse", "dense")}
    pool = fuse.pooled(two).withColumn(
        "ranker_no", F.when(F.col("ranker") == "sparse", 0).otherwise(1))
    return metrics.budgeted(metrics.judging_pool(pool, k=6), per_query=5, budget=40)


_AUTO = "case when d.n_chars between 200 and 20000 then 1 else 0 end"


def label_pairs(spark, sf_dir):
    """A length rule as automatic label next to the given quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rule = F.when(F.col("n_chars").between(200, 20000), 1).otherwise(0)
    return (table(spark, sf_dir, "labels").join(docs, "doc_id")
            .select("doc_id", "lang", rule.alias("auto"), F.col("quality").alias("human")))


@query("agreement_report", f"""
select lang, count(*) as n, count(*) filter (where auto = human) as agree,
  count(*) filter (where auto <> human and human = 1) as stricter,
  count(*) filter (where auto <> human and human = 0) as looser,
  round(count(*) filter (where auto = human) / count(*)::double, 6) as share
from (select d.lang, {_AUTO} as auto, l.quality as human from labels l join documents d using (doc_id))
group by lang""")
def agreement_report(spark, sf_dir):
    return metrics.agreement(label_pairs(spark, sf_dir), ["lang"]).withColumn("share", r6("share"))


@query("label_disagreements", f"""
select doc_id, lang, auto, human from (select l.doc_id, d.lang, {_AUTO} as auto, l.quality as human
  from labels l join documents d using (doc_id)) where auto <> human""")
def label_disagreements(spark, sf_dir):
    return metrics.disagreements(label_pairs(spark, sf_dir))


@query("label_totals", "select count(*) as judged, sum(quality)::bigint as relevant from labels")
def label_totals(spark, sf_dir):
    return metrics.label_totals(table(spark, sf_dir, "labels")
                                .select(F.col("quality").alias("label")))


@query("latency_percentiles", with_sql(("ev",), """
select type, p50, p95 from (
  select type, list(value order by value) as v, count(*) as n from ev group by type) t,
  lateral (select v[round_even(0.5::double * (n - 1), 0)::int + 1] as p50,
                  v[round_even(0.95::double * (n - 1), 0)::int + 1] as p95)"""))
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of the event values per type, as for query times."""
    return metrics.nearest_rank_percentile(events(spark, sf_dir), ["type"], "value", (50, 95))
