"""Checks that must find what was planted, human labels against rules, and translated rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldseq.operators import dense, fuse, metrics, notes, rubrics, xg
from fieldseq.operators.possessions import zone_line
from fieldseq.plans.base import cte, query, r6, stored_possessions, with_sql
from fieldseq.plans.eval_set import FILTER_DOMINATED
from fieldseq.plans.evaluation_queries import RANKERS, RULES, VERDICT, _profile
from fieldseq.plans.model_queries import _TEST, TEST_GROUPS, model_rows
from fieldseq.plans.result_queries import search_job_tables
from fieldseq.plans.search_queries import hint_tokens, token_index
from fieldseq.plans.translation_queries import eval_texts, parsed_queries


@query("planted_leaks", with_sql(("mrows",), f"""
select distinct grp as "group" from mrows where grp not in {_TEST} and hash_id = 0""".replace(
    "hash_id", "event_id % 40")))
def planted_leaks(spark, sf_dir):
    """A split into which some rows of training groups were put on the other side as well."""
    train, test = xg.split(model_rows(spark, sf_dir), TEST_GROUPS)
    strays = train.filter(F.col("event_id").cast("bigint") % 40 == 0)
    return xg.shared_groups(train, test.unionByName(strays))


@query("planted_citations", with_sql(("evalgiven", "nt_claims", "page"), """
select qid, claim_no, c.uid from (select qid, claim_no, unnest(string_split(uids, ',')) as uid
  from nt_claims where claim_no <= 5) c join page p using (qid, uid) where p.rank = 0"""))
def planted_citations(spark, sf_dir):
    """Claims held against pages whose best row was taken away: all that cite it are found."""
    job = search_job_tables(spark, sf_dir)
    return notes.unsupported(job["notes"], job["page"].filter("rank > 0"))


_MARK = "(start_idx + n_events) % 3 = 0"
cte("human", " union all ".join(
    f"select '{q}' as qid, uid, ({_MARK})::int as human from poss" for q in sorted(RULES)[:4])
    + " union all select 'q01', 'no such', 1", ("poss",))


@query("audit_pairs", with_sql(("human", "poss"), f"""
select qid, uid, human, {VERDICT} as auto from human join poss using (uid)"""))
def audit_pairs(spark, sf_dir):
    """Labels given by another rule, with one for an unknown id, beside the verdicts of the rubrics."""
    items = stored_possessions(spark, sf_dir)
    asked = F.explode(F.array(*[F.lit(q) for q in sorted(RULES)[:4]])).alias("qid")
    given = items.select(asked, "uid", F.expr(_MARK.replace("::int", "")).cast("int").alias("human"))
    unknown = spark.createDataFrame([("q01", "no such", 1)], "qid string, uid string, human int")
    return metrics.audit_pairs(given.unionByName(unknown), items).select("qid", "uid", "human", "auto")


cte("parsed_vec", f"""select qid, v, sqrt(list_dot_product(v, v)) as n from (select qid,
    {_profile("regexp_replace(regexp_replace(hint, '[^ ]*@', '', 'g'), '[+>^]+( |$)', '" + chr(92) + "1', 'g')")}
    as v from parsedq)""", ("parsedq",))
cte("parsed_sparse", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select qid, uid, round(sum(weight * qw), 9) as score from pt_post join pq_vec using (gram)
      group by qid, uid) semi join pcand using (qid, uid) where score > 0) where rank < 50""",
    ("pt_post", "pq_vec", "pcand"))
cte("parsed_dense", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select h.qid, p.uid, round(list_dot_product(h.v, p.v) / (h.n * p.n), 9) as score
      from parsed_vec h join pcand using (qid) join poss_vec p on p.uid = pcand.uid where h.n > 0)) where rank < 50""",
    ("parsed_vec", "poss_vec", "pcand"))
cte("parsed_pool", """select qid, 'sparse' as ranker, uid, rank from parsed_sparse where rank < 10
    union all select qid, 'dense', uid, rank from parsed_dense where rank < 10
    union all select * from (select qid, 'fused', uid, (row_number() over
      (partition by qid order by score desc, uid) - 1)::int as rank from (
        select qid, uid, sum(1.0::double / (61 + rank)) as score from (
          select qid, uid, rank from parsed_sparse union all select qid, uid, rank from parsed_dense)
        group by qid, uid)) where rank < 10""", ("parsed_sparse", "parsed_dense"))
cte("parsed_metrics", f"""select qid, ranker, coalesce(p5, 0) as p5, coalesce(p10, 0) as p10, coalesce(mrr, 0) as mrr
    from (select qid, ranker from parsedq, (values ('sparse'), ('dense'), ('fused')) r(ranker)) left join (
      select qid, ranker, sum(label) filter (where rank < 5) / 5.0::double as p5, sum(label) / 10.0::double as p10,
        1.0::double / (min(rank) filter (where label = 1) + 1) as mrr
      from (select e.*, {VERDICT} as label from parsed_pool e join poss p using (uid)) group by qid, ranker)
    using (qid, ranker)""", ("parsed_pool", "parsedq", "poss"))
_DOMINATED = ", ".join(f"'{q}'" for q in FILTER_DOMINATED)


@query("translated_rankers", with_sql(("parsed_metrics",), f"""
select subset, ranker, round(avg(p5), 6) as p5, round(avg(p10), 6) as p10, round(avg(mrr), 6) as mrr from (
  select 'all' as subset, * from parsed_metrics
  union all select 'discriminating', * from parsed_metrics where qid not in ({_DOMINATED}))
group by subset, ranker"""))
def translated_rankers(spark, sf_dir):
    """P@5, P@10 and reciprocal rank of the sparse, dense and fused rankings of translated texts."""
    items = stored_possessions(spark, sf_dir)
    asked = parsed_queries(spark, items, eval_texts()).withColumn(
        "embedding", dense.zone_profile(zone_line(F.col("hint"))))
    vectors = items.select("uid", dense.zone_profile(F.col("zone_path")).alias("embedding"))
    found = fuse.hybrid(asked, items, token_index(items), hint_tokens(), vectors, 10, shared=True)
    pool = fuse.pooled({r: found[r].filter(F.col("rank") < 10) for r in RANKERS})
    rows = pool.join(items.select("uid", "token_string", "zone_path", "n_events", "ended_in_shot"), "uid").select(
        "qid", "ranker", "rank", rubrics.judged(F.col("qid")).alias("label"))
    per_query = metrics.ranking_metrics(rows, asked, list(RANKERS))
    telling = F.when(~F.col("qid").isin(*FILTER_DOMINATED), "discriminating")
    return (per_query.withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), telling))))
            .groupBy("subset", "ranker").agg(*[r6(F.avg(c)).alias(c) for c in ("p5", "p10", "mrr")]))
