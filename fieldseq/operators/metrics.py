"""Evaluation of rankings, labels and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseq.operators import order_stats, rubrics
from fieldseq.operators.filters import Filters
from fieldseq.operators.quality import seeded_order


def ranking_metrics(judged: DataFrame, queries: DataFrame, rankers: Sequence[str]) -> DataFrame:
    """P@5, P@10 and reciprocal rank per (query, ranker).

    `judged` has qid, ranker, 0-based rank and 0/1 label, for ranks below ten.
    Precision divides by k even when fewer results exist; a query without
    results scores 0.
    """
    names = F.array(*[F.lit(r) for r in rankers])
    grid = queries.select("qid", F.explode(names).alias("ranker"))
    hit = F.col("label") == 1
    found = judged.groupBy("qid", "ranker").agg(
        (F.sum(F.when(hit & (F.col("rank") < 5), 1).otherwise(0)) / 5).alias("p5"),
        (F.sum(F.when(hit & (F.col("rank") < 10), 1).otherwise(0)) / 10).alias("p10"),
        (1 / (F.min(F.when(hit, F.col("rank"))) + 1)).alias("mrr"))
    return grid.join(found, ["qid", "ranker"], "left").fillna(0.0, ["p5", "p10", "mrr"])


def macro_means(per_query: DataFrame, subsets: Mapping[str, Column]) -> DataFrame:
    """Mean of the three metrics per ranker, for each named subset of the queries."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    return (per_query.withColumn("subset", F.explode(tags)).groupBy("subset", "ranker")
            .agg(F.count("*").alias("n_queries"), F.avg("p5").alias("p5"),
                 F.avg("p10").alias("p10"), F.avg("mrr").alias("mrr")))


def nearest_rank_percentile(values: DataFrame, by: Sequence[str], value: str,
                            percents: Sequence[int]) -> DataFrame:
    """Value at place round(p/100 * (n-1)) of the sorted values, half to even."""
    ranked = order_stats.cumulative(values, value, by)
    positions = {f"p{p}": F.bround(F.lit(p / 100.0) * (F.col("total") - 1), 0) for p in percents}
    return order_stats.values_at(ranked, value, positions, by)


def rubric_statistics(possessions: DataFrame, wanted: Mapping[str, Filters],
                      dominated_from: float = 0.9) -> DataFrame:
    """Per query: rows passing the filters, relevant ones among them, rate, dominated flag.

    One pass over the possessions; every count is a conditional sum.
    """
    rules = rubrics.predicates()
    counts = possessions.agg(*[
        F.struct(F.count_if(f.predicate()).alias("n_filtered"),
                 F.count_if(f.predicate() & rules[q]).alias("n_relevant")).alias(q)
        for q, f in wanted.items()])
    entries = F.array(*[F.struct(F.lit(q).alias("qid"), F.col(q)["n_filtered"].alias("n_filtered"),
                                 F.col(q)["n_relevant"].alias("n_relevant")) for q in wanted])
    rate = F.try_divide(F.col("n_relevant"), F.col("n_filtered"))
    return (counts.select(F.explode(entries).alias("e")).select("e.*")
            .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
            .withColumn("dominated", F.col("rate") >= dominated_from))


def agreement(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion of an automatic and a human 0/1 label."""
    auto, human = F.col("auto"), F.col("human")
    return (pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(auto == human).alias("agree"),
        F.count_if((auto != human) & (human == 1)).alias("stricter"),
        F.count_if((auto != human) & (human == 0)).alias("looser"))
        .withColumn("share", F.try_divide(F.col("agree"), F.col("n"))))


def audit_pairs(labels: DataFrame, possessions: DataFrame) -> DataFrame:
    """Human labels (qid, uid, human) with the rule's verdict; unknown ids are dropped."""
    # Labels may be as many as possessions, whose lines are far larger than the files they are estimated by.
    lines = possessions.select("uid", "token_string", "zone_path", "n_events", "ended_in_shot")
    rows = labels.join(lines.hint("merge"), "uid")
    return rows.select("qid", "uid", "human", rubrics.judged(F.col("qid")).alias("auto"),
                       "token_string")


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("auto") != F.col("human"))


def label_totals(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count("*").alias("judged"), F.sum("label").alias("relevant"))


def filter_agreement(hand: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per query: are the two filter structs equal, nulls counting as equal?"""
    both = hand.select("qid", F.col("filters").alias("a")).join(
        parsed.select("qid", F.col("filters").alias("b")), "qid")
    return both.select("qid", F.col("a").eqNullSafe(F.col("b")).alias("identical"))


def ranker_overlap(pool: DataFrame, left: str, right: str, k: int = 10) -> DataFrame:
    """Number of items two rankers share in their first k, per query."""
    top = pool.filter(F.col("rank") < k)
    both = top.groupBy("qid", "uid").agg(
        (F.bool_or(F.col("ranker") == left) & F.bool_or(F.col("ranker") == right)).alias("both"))
    return both.groupBy("qid").agg(F.count_if("both").alias("shared"))


def length_diagnostic(ranked: DataFrame, possessions: DataFrame, k: int = 5) -> DataFrame:
    """Median token count of the first k results against that of the corpus."""
    top = ranked.filter(F.col("rank") < k).join(possessions.select("uid", "n_events"), "uid")
    half = order_stats.linear_quantiles(top, "n_events", [0.5])
    corpus = order_stats.linear_quantiles(possessions, "n_events", [0.5])
    return half.select(F.get("edges", 0).alias("median_top"),
                       F.lit(corpus.select(F.get("edges", 0)).scalar()).alias("median_corpus"))


def judging_pool(pool: DataFrame, judged: DataFrame | None = None, k: int = 10,
                 seed: int = 11) -> DataFrame:
    """Ordered distinct union of ranked lists minus judged items, plus a blind order.

    `pool` has qid, ranker order (`ranker_no`), rank and uid. Position follows the
    first list an item is in; `blind_order` is a seeded shuffle by hash.
    """
    place = F.min(F.struct("ranker_no", "rank")).alias("first")
    merged = pool.filter(F.col("rank") < k).groupBy("qid", "uid").agg(place)
    if judged is not None:
        merged = merged.join(judged.select("qid", "uid"), ["qid", "uid"], "left_anti")
    w = Window.partitionBy("qid")
    return merged.select(
        "qid", "uid", (F.row_number().over(w.orderBy("first", "uid")) - 1).alias("position"),
        (F.row_number().over(w.orderBy(seeded_order(F.col("uid"), seed), F.col("uid"))) - 1)
        .alias("blind_order"))


def budgeted(pool: DataFrame, per_query: int, budget: int, seed: int = 11) -> DataFrame:
    """At most `per_query` items of each query until `budget` items are taken overall.

    Queries come in a seeded order. Whole-table order is only taken over one
    count per query.
    """
    some = pool.filter(F.col("blind_order") < per_query)
    turn = Window.orderBy(seeded_order(F.col("qid"), seed), F.col("qid"))
    before = (some.groupBy("qid").agg(F.count("*").alias("n"))
              .withColumn("taken_before", F.coalesce(F.sum("n").over(
                  turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (some.join(before, "qid")
            .filter(F.col("taken_before") + F.col("blind_order") < budget)
            .select("qid", "uid", "position", "blind_order"))


def paired_change(before: DataFrame, after: DataFrame, drop: float = 0.19) -> DataFrame:
    """Metric of rephrased queries against the originals; unknown ids are skipped."""
    both = before.select("qid", F.col("p5").alias("p5_before")).join(
        after.select("qid", F.col("p5").alias("p5_after")), "qid")
    return (both.withColumn("delta", F.col("p5_after") - F.col("p5_before"))
            .withColumn("loser", F.col("delta") < -drop))


def change_summary(changes: DataFrame) -> DataFrame:
    """Mean metric before and after, mean change and number of losers."""
    return changes.agg(F.count("*").alias("n"), F.avg("p5_before").alias("p5_before"),
                       F.avg("p5_after").alias("p5_after"), F.avg("delta").alias("mean_delta"),
                       F.count_if("loser").alias("n_losers"))
