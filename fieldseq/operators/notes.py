"""Short cited summaries of a result page.

Every claim is computed from a subset of the page's rows and carries the ids of
exactly that subset. A page has at most `PAGE` rows per query, so the rows of a
query fit in one small array and all claims are expressions over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 8
MAX_CLAIMS = 5
MIN_SUPPORT = 2
# Fixed values of the summary rules.
SHORT_LENGTH, LONG_LENGTH, STANDOUT_XG = 8, 20, 0.15

_INPUTS = ("rank", "uid", "team", "opponent", "play_pattern", "zone_path", "n_events",
           "duration_s", "ended_in_shot", "ended_in_goal")


def _mode(values: Column) -> Column:
    """struct(n, value) of the most frequent value; the one seen first wins ties."""
    counted = F.transform(F.array_distinct(values), lambda v, i: F.struct(
        F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("place"),
        v.alias("value")))
    return F.array_max(counted)


def _uids(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["uid"])


def _mean_xg(rows: Column) -> Column:
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["xg"]), F.size(rows))


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(ordered)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return (upper.cast("double") + lower.cast("double")) / 2


def _two(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x, 2))


def _whole(x: Column) -> Column:
    return F.format_string("%.0f", F.bround(x, 0))


def _claim(kind: str, fits: Column, label: Column, support: Column, value: Column,
           uids: Column, text: Column) -> Column:
    return F.when(fits, F.struct(
        F.lit(kind).alias("kind"), label.cast("string").alias("label"),
        support.cast("int").alias("support"), value.cast("double").alias("value"),
        uids.alias("uids"), text.alias("text")))


def page_rows(ranked: DataFrame, page: int = PAGE) -> DataFrame:
    return ranked.filter(F.col("rank") < page)


def claims(rows: DataFrame, given: DataFrame | None = None, query_id: str = "qid") -> DataFrame:
    """(qid, claim_no, kind, label, support, of_n, value, uids, text), at most five per query.

    `rows` are ranked result rows; only those with rank below `PAGE` count. Their
    xg is the model's total where there is one, else the provider's. `given`
    (qid, array of field names) lists what the query itself fixed, which is then
    not restated.
    """
    mine = F.col("my_xg_sum") if "my_xg_sum" in rows.columns else F.lit(None).cast("double")
    xg = F.coalesce(mine, F.col("xg_sum"), F.lit(0.0)).cast("double")
    pages = (page_rows(rows).groupBy(query_id)
             .agg(F.array_sort(F.collect_list(F.struct(*_INPUTS, xg.alias("xg")))).alias("rows"))
             .withColumn("n", F.size("rows")).filter(F.col("n") >= MIN_SUPPORT))
    if given is not None:
        pages = pages.join(given.select(query_id, F.col("given").alias("_given")), query_id, "left")
    else:
        pages = pages.withColumn("_given", F.lit(None).cast("array<string>"))
    pages = pages.withColumn("_given", F.coalesce("_given", F.array().cast("array<string>")))

    n = F.col("n")
    last_zone = F.transform("rows", lambda r: F.substring_index(r["zone_path"], " ", -1))
    pages = pages.select(
        "*", _mode(F.transform("rows", lambda r: r["team"])).alias("team"),
        F.size(F.array_distinct(F.transform("rows", lambda r: r["team"]))).alias("teams"),
        _mode(F.filter(F.transform("rows", lambda r: r["play_pattern"]),
                       lambda p: p != "")).alias("pattern"),
        F.filter("rows", lambda r: r["ended_in_shot"]).alias("shots"),
        F.filter("rows", lambda r: r["ended_in_goal"]).alias("goals"),
        _mode(F.filter(last_zone, lambda z: z != "")).alias("zone"),
        _median(F.transform("rows", lambda r: r["n_events"])).alias("med_len"),
        _median(F.transform("rows", lambda r: r["duration_s"])).alias("med_dur"),
        F.array_max(F.transform("rows", lambda r: F.struct(
            r["xg"].alias("xg"), (-r["rank"]).alias("place"), r["uid"].alias("uid"),
            r["team"].alias("team"), r["opponent"].alias("opponent")))).alias("best"))

    def given_has(name: str) -> Column:
        return F.array_contains("_given", name)

    def of(key: str, chosen: Column) -> Column:
        return _uids(F.filter("rows", lambda r: r[key] == chosen))

    team, pattern, zone, best = F.col("team"), F.col("pattern"), F.col("zone"), F.col("best")
    shots_n, goals_n = F.size("shots"), F.size("goals")
    shot_xg, goal_xg = _mean_xg(F.col("shots")), _mean_xg(F.col("goals"))
    dominant = team["n"] >= F.greatest(F.lit(MIN_SUPPORT), F.floor(n / 2))
    in_zone = F.filter("rows", lambda r: F.substring_index(r["zone_path"], " ", -1) == zone["value"])
    tempo = (F.when(F.col("med_len") <= SHORT_LENGTH, "short and direct")
             .when(F.col("med_len") >= LONG_LENGTH, "sustained").otherwise("moderate"))
    touch = F.when(F.col("med_len").cast("int") == 1, "touch").otherwise("touches")
    nothing = F.lit(None)

    made = F.array_compact(F.array(
        _claim("team", ~given_has("team") & dominant, team["value"], team["n"], nothing,
               of("team", team["value"]),
               F.concat(team["value"], F.lit(": "), team["n"], F.lit(" of "), n, F.lit(" results."))),
        _claim("teams", ~given_has("team") & ~dominant & (F.col("teams") >= 3), team["value"],
               F.col("teams"), team["n"], _uids(F.col("rows")),
               F.concat(F.col("teams"), F.lit(" different teams appear; "), team["value"],
                        F.lit(" leads with "), team["n"], F.lit(" of "), n, F.lit("."))),
        _claim("pattern", ~given_has("play_pattern") & (pattern["n"] >= MIN_SUPPORT)
               & (pattern["n"] > F.floor(n / 3)), pattern["value"], pattern["n"], nothing,
               of("play_pattern", pattern["value"]),
               F.concat(F.lit("Usual start: "),
                        F.replace(F.lower(pattern["value"]), F.lit("from "), F.lit("")),
                        F.lit(", "), pattern["n"], F.lit(" times."))),
        _claim("chance", given_has("ended_in_shot") & (shots_n > 0), nothing, shots_n, shot_xg,
               _uids(F.col("shots")),
               F.concat(F.lit("Mean chance value: "), _two(shot_xg), F.lit(" xG."))),
        _claim("shots", ~given_has("ended_in_shot") & (shots_n >= MIN_SUPPORT), nothing, shots_n,
               shot_xg, _uids(F.col("shots")),
               F.concat(F.lit("Shots close "), shots_n, F.lit(" of "), n,
                        F.lit(" sequences, mean value "), _two(shot_xg), F.lit(" xG."))),
        _claim("goals", ~given_has("ended_in_goal") & (goals_n > 0), nothing, goals_n, goal_xg,
               _uids(F.col("goals")),
               F.concat(F.lit("Goals: "), goals_n, F.lit(" of "), n, F.lit(", mean value "),
                        _two(goal_xg), F.lit(" xG."))),
        _claim("finish", ~given_has("end_zone") & (zone["n"] >= MIN_SUPPORT), zone["value"],
               zone["n"], nothing, _uids(in_zone),
               F.concat(F.lit("Usual last zone: "), zone["value"], F.lit(", "), zone["n"],
                        F.lit(" of "), n, F.lit("."))),
        _claim("tempo", F.lit(True), tempo, n, F.col("med_len"), _uids(F.col("rows")),
               F.concat(F.lit("Tempo "), tempo, F.lit(", typically "),
                        _whole(F.col("med_len")), F.lit(" "), touch, F.lit(" in "),
                        _whole(F.col("med_dur")), F.lit(" s."))),
        _claim("standout", best["xg"] > STANDOUT_XG, best["team"], F.lit(1), best["xg"],
               F.array(best["uid"]),
               F.concat(F.lit("Top chance: "), best["team"], F.lit(" v "), best["opponent"],
                        F.lit(", "), _two(best["xg"]), F.lit(" xG.")))))
    return (pages.select(query_id, "n", F.posexplode(F.slice(made, 1, MAX_CLAIMS)).alias("i", "c"))
            .select(query_id, (F.col("i") + 1).alias("claim_no"), "c.kind", "c.label", "c.support",
                    F.col("n").alias("of_n"), "c.value", "c.uids", "c.text"))


def unsupported(made: DataFrame, rows: DataFrame, query_id: str = "qid") -> DataFrame:
    """Claims that cite an id which is not in the result rows of their query."""
    cited = made.select(query_id, "claim_no", F.explode("uids").alias("uid"))
    return cited.join(rows.select(query_id, "uid"), [query_id, "uid"], "left_anti")
