"""Queries that translate descriptions and search with the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.operators import filters, fuse, metrics, rubrics, sparse
from fieldseq.plans import jobs
from fieldseq.plans.base import cte, possessions, query, r6, stored_possessions, with_sql
from fieldseq.plans.eval_set import (EXPECTED_FAILURES, FILTER_DOMINATED, PARAPHRASES, query_table,
                                     stand_in, translated)
from fieldseq.plans.evaluation_queries import VERDICT
from fieldseq.plans.search_queries import (EVAL, hint_tokens, query_ctes, sql_predicate,
                                           token_index)

PARSED = translated()


def texts(spark: SparkSession, chosen: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(chosen.items()), "qid string, text string")


def parsed_queries(spark, items, chosen: dict[str, str]) -> DataFrame:
    return jobs.translate(texts(spark, chosen), items)


def eval_texts() -> dict[str, str]:
    return {q: text for q, (text, _f, _h) in EVAL.items()}


def judged_sparse(asked: DataFrame, items: DataFrame, index: sparse.SparseIndex) -> DataFrame:
    found = fuse.hybrid(asked, items, index, hint_tokens())["sparse"].filter(F.col("rank") < 10)
    rows = found.join(items.select("uid", "token_string", "zone_path", "n_events",
                                   "ended_in_shot"), "uid")
    return rows.select("qid", F.lit("sparse").alias("ranker"), "rank",
                       rubrics.judged(F.col("qid")).alias("label"))


def precision(asked: DataFrame, items: DataFrame, index: sparse.SparseIndex) -> DataFrame:
    return metrics.ranking_metrics(judged_sparse(asked, items, index), asked, ["sparse"])


def _parsed_values() -> str:
    rows = []
    for q, (_t, f, hint) in PARSED.items():
        def v(x):
            return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
        rows.append(f"('{q}', '{hint}', {v(f.team)}, {v(f.play_pattern)}, {v(f.start_band)}, "
                    f"{v(f.end_band)}, {v(f.end_zone)}, {v(f.ended_in_shot)}, "
                    f"{v(f.ended_in_goal)}, {v(f.min_xg)}, {v(f.min_events)})")
    return ", ".join(rows)


cte("parsedq", f"""select * from (values {_parsed_values()}) as t(qid, hint, team, play_pattern,
    start_band, end_band, end_zone, ended_in_shot, ended_in_goal, min_xg, min_events)""")


@query("plan_queries", with_sql(("parsedq",), """
select qid, hint, team, play_pattern, start_band, end_band, end_zone, ended_in_shot, ended_in_goal,
  min_xg::double as min_xg, min_events::double as min_events from parsedq"""))
def plan_queries(spark, sf_dir):
    """Translation of the evaluation texts against the names in the possessions."""
    p = parsed_queries(spark, possessions(spark, sf_dir), eval_texts())
    return p.select("qid", "hint", *[f"filters.{c}" for c in (
        "team", "play_pattern", "start_band", "end_band", "end_zone", "ended_in_shot",
        "ended_in_goal", "min_xg")], F.col("filters.min_events").cast("double").alias("min_events"))


_WORDS = {"From Corner": "corner", "From Counter": "counter-attack", "From Throw In": "throw-in",
          "Regular Play": "open play"}
_HINTS = {("From Corner", False): "SETP@F-R> RECV@F-C",
          ("From Corner", True): "SETP@F-R> RECV@F-C SHOT@F-C",
          ("From Throw In", False): "SETP@F-R",
          ("From Throw In", True): "SETP@F-R PASS@F-R RECV@F-C SHOT@F-C"}
_HINT_SQL = "case " + " ".join(
    f"when play_pattern = '{p}' and ended_in_shot = {str(s).lower()} then '{h}'"
    for (p, s), h in _HINTS.items()) + """ when ended_in_shot then 'RECV@F-C CARRY@F-C SHOT@F-C'
    else 'RECV@F-C CARRY@F-C CARRY@F-C' end"""


@query("plan_descriptions", with_sql(("poss",), f"""
select uid, team, play_pattern, case when ended_in_shot then true end as ended_in_shot,
  {_HINT_SQL} as hint, 'ended here' as ignored
from poss"""))
def plan_descriptions(spark, sf_dir):
    """Each possession described in words, and the descriptions translated back."""
    items = stored_possessions(spark, sf_dir)
    kind = F.lit(None)
    for pattern, words in _WORDS.items():
        kind = F.when(F.col("play_pattern") == pattern, words).otherwise(kind)
    text = F.concat_ws(" ", "team", kind, F.when(F.col("ended_in_shot"), "ending in a shot"),
                       F.lit("ended here"))
    described = items.select(F.col("uid").alias("qid"), text.alias("text"))
    return jobs.translate(described, items).select(
        F.col("qid").alias("uid"), "filters.team", "filters.play_pattern", "filters.ended_in_shot",
        "hint", "ignored")


cte("pcand", " union all ".join(
    f"select '{q}' as qid, uid from poss where {sql_predicate(f)}"
    for q, (_, f, _h) in PARSED.items()), ("poss",))
query_ctes("pq", "pt", "select qid, string_split(hint, ' ') as w from parsedq", ("parsedq",))
cte("parsed_top", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select qid, uid, round(sum(weight * qw), 9) as score from pt_post join pq_vec using (gram)
      group by qid, uid) semi join pcand using (qid, uid) where score > 0) where rank < 10""",
    ("pt_post", "pq_vec", "pcand"))


def _p5(name: str, top: str) -> str:
    return (f"select qid, coalesce(sum(label) filter (where rank < 5), 0) / 5.0::double as {name} from "
            f"(select t.qid, t.rank, {VERDICT} as label from {top} t join poss using (uid)) group by qid")


_IDENTICAL = ", ".join(f"'{q}'" for q, (_t, f, _h) in PARSED.items() if f == EVAL[q][1])
_DOMINATED = ", ".join(f"'{q}'" for q in FILTER_DOMINATED)
cte("translation", f"""select q.qid, coalesce(h.hand_p5, 0) as hand_p5, coalesce(p.parsed_p5, 0) as parsed_p5,
    q.qid in ({_IDENTICAL}) as identical from evalq q left join ({_p5('hand_p5', 'sparse_top')}) h using (qid)
    left join ({_p5('parsed_p5', 'parsed_top')}) p using (qid)""",
    ("evalq", "sparse_top", "parsed_top", "poss"))


def hand_and_parsed(spark, sf_dir):
    """Precision of hand-written and translated queries side by side."""
    items = stored_possessions(spark, sf_dir)
    index = token_index(items).shared()
    hand = query_table(spark, EVAL)
    parsed = parsed_queries(spark, items, eval_texts())
    same = metrics.filter_agreement(hand, parsed)
    left = precision(hand, items, index).select("qid", F.col("p5").alias("hand_p5"))
    right = precision(parsed, items, index).select("qid", F.col("p5").alias("parsed_p5"))
    return left.join(right, "qid").join(same, "qid")


@query("translation_per_query", with_sql(("translation",), """
select qid, round(hand_p5, 6) as hand_p5, round(parsed_p5, 6) as parsed_p5, identical from translation"""))
def translation_per_query(spark, sf_dir):
    return hand_and_parsed(spark, sf_dir).select(
        "qid", r6("hand_p5").alias("hand_p5"), r6("parsed_p5").alias("parsed_p5"), "identical")


@query("translation_report", with_sql(("translation",), f"""
select subset, count(*) as n, count(*) filter (where identical) as n_identical,
  round(avg(hand_p5), 6) as hand_p5, round(avg(parsed_p5), 6) as parsed_p5 from (
    select 'all' as subset, * from translation union all
    select 'discriminating', * from translation where qid not in ({_DOMINATED}) union all
    select 'identical filters', * from translation where identical and qid not in ({_DOMINATED}))
group by subset"""))
def translation_report(spark, sf_dir):
    """Means over all, discriminating, and identically filtered queries."""
    rows = hand_and_parsed(spark, sf_dir)
    telling = ~F.col("qid").isin(*FILTER_DOMINATED)
    tags = F.array_compact(F.array(
        F.lit("all"), F.when(telling, "discriminating"),
        F.when(telling & F.col("identical"), "identical filters")))
    return (rows.withColumn("subset", F.explode(tags)).groupBy("subset")
            .agg(F.count("*").alias("n"), F.count_if("identical").alias("n_identical"),
                 r6(F.avg("hand_p5")).alias("hand_p5"), r6(F.avg("parsed_p5")).alias("parsed_p5")))


@query("paraphrase_report")
def paraphrase_report(spark, sf_dir):
    """Precision of rephrased texts against the originals, expected failures marked."""
    items = stored_possessions(spark, sf_dir)
    index = token_index(items).shared()
    before = precision(parsed_queries(spark, items, eval_texts()), items, index)
    other = {q: stand_in(t) for q, t in PARAPHRASES.items()}
    after = precision(parsed_queries(spark, items, other), items, index)
    return metrics.paired_change(before, after).withColumn(
        "expected_failure", F.col("qid").isin(*EXPECTED_FAILURES))


@query("paraphrase_summary")
def paraphrase_summary(spark, sf_dir):
    """Mean change over the paraphrases that are not expected to fail."""
    changes = paraphrase_report(spark, sf_dir)
    return metrics.change_summary(changes.filter(~F.col("expected_failure")))


@query("explicit_over_parsed", with_sql(("poss",), " union all ".join(
    "select '{}' as qid, uid from poss where {}".format(q, sql_predicate(
        f.overridden_by(filters.Filters(play_pattern="From Corner", ended_in_shot=False))))
    for q, (_t, f, _h) in PARSED.items())))
def explicit_over_parsed(spark, sf_dir):
    """Candidates of translated filters in which explicitly given fields win."""
    explicit = filters.Filters(play_pattern="From Corner", ended_in_shot=False)
    asked = query_table(spark, PARSED)
    given = query_table(spark, {q: ("", explicit, "") for q in PARSED}).select(
        "qid", F.col("filters").alias("_given"))
    merged = asked.join(given, "qid").select(
        "qid", filters.merged(F.col("filters"), F.col("_given")).alias("filters"))
    return filters.candidate_pairs(possessions(spark, sf_dir), merged).select("qid", "uid")
