"""URL filters: host and path rules, and link-graph propagation where no rule fits.

Trust starts at hosts whose pages are allowed by a rule and follows links; distrust
starts at hosts with blocked pages and follows links backwards. Both are personalised
PageRank over host edges; a host whose distrust exceeds its trust is blocked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.llm.base import query, stored, table

# The rules of the contract, as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, SMALLEST = 0.85, 1e-9


def rounds_to(damping: float, smallest: float) -> int:
    """Rounds after which less than `smallest` moves on any graph: what moves shrinks by `damping`."""
    return math.ceil(math.log(smallest / 2) / math.log(damping)) + 1


ROUNDS = rounds_to(DAMPING, SMALLEST)
_UPPER = "".join(map(chr, range(65, 91)))


def _host(after: Column) -> Column:
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def with_host(pages: DataFrame) -> DataFrame:
    """Add host and path; both empty for a null url or one without `://`."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({"host": _host(rest),
                              "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host all rules for it or a domain above it, longest first."""
    labels = F.split("host", r"\.")
    tails = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    row = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("order"),
                   F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"),
                   "verdict")
    return (tails.filter("host <> ''").join(rules, "rule_host").groupBy("host")
            .agg(F.sort_array(F.collect_set(row)).alias("rules")))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts: pages of src with a link to dst."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(
        r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^"'\s>]+)"""), F.lit(1))
    targets = F.array_distinct(F.transform(links, _host))
    return (pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
            .filter("src <> dst and src <> '' and dst <> ''")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              smallest: float = SMALLEST) -> DataFrame:
    """(kind, host, value): both walks at once, by kind `trust` and `distrust`.

    Seeds are (kind, host, seed). Mass at hosts without a way out returns to the
    seeds of its kind. Each round is one join on the source host and one sum, written
    to the shared folder; it ends when less than `smallest` moved, which takes
    up to `rounds_to` rounds (133 by default), or after `rounds` when given.
    """
    ways = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), "dst", "n")
            .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"),
                                      F.col("src").alias("dst"), "n")))
    outs = ways.groupBy("kind", "host").agg(F.sum("n").alias("_all"))
    ways = stored(ways.join(outs, ["kind", "host"]).select(
        "kind", "host", "dst", (F.col("n") / F.col("_all")).alias("share")), "ways")
    mass = seeds.groupBy("kind").agg(F.sum("seed").alias("_mass"))
    seeds = stored(seeds.join(mass, "kind"), "seeds")
    ranks = seeds.select("kind", "host", F.col("seed").alias("value"))
    if ways.isEmpty():
        return ranks
    for k in range(rounds_to(damping, smallest) if rounds is None else rounds):
        sent = stored(ranks.join(ways, ["kind", "host"])
                      .groupBy("kind", F.col("dst").alias("host"))
                      .agg(F.sum(F.col("value") * F.col("share")).alias("got")), f"sent{k}")
        kept = sent.groupBy("kind").agg(F.sum("got").alias("_moved"))
        back = seeds.join(kept, "kind", "left").select(
            "kind", "host", (F.col("seed") / F.col("_mass") * (
                F.col("_mass") - F.lit(damping) * F.coalesce("_moved", F.lit(0.0)))).alias("got"))
        new = stored(sent.select("kind", "host", (F.col("got") * damping).alias("got"))
                     .unionByName(back).groupBy("kind", "host").agg(F.sum("got").alias("value")),
                     f"ranks{k}")
        change = (new.withColumnRenamed("value", "_new")
                  .join(ranks, ["kind", "host"], "full")
                  .agg(F.sum(F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))))
                       .alias("d")).first().d)
        ranks = new
        if (change or 0.0) < smallest:
            break
    return ranks


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict and the host's trust and distrust.

    The longest fitting rule decides; else the host's propagated scores, equal ones
    (also hosts never reached, and urls without a host) allowing. Null html has no
    links. Repeated rows are judged alike; extra columns are ignored.
    """
    spark = pages.sparkSession
    placed = with_host(pages.select("page_id", "url", "html"))
    given = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    slim = stored(placed.select("page_id", "url", "host", "path"), "page_hosts")
    counts = slim.groupBy("host").agg(F.count("*").alias("n_pages"))
    by_host = stored(counts.join(host_rules(counts, F.broadcast(given)), "host", "left"),
                     "host_rules")
    first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])),
                             F.lit(1))
    ruled = stored(slim.join(by_host, "host").withColumn("_r", first).select(
        "page_id", "url", "host", "path", F.col("_r.rule").alias("rule"),
        F.col("_r.verdict").alias("ruled")), "ruled_pages")
    total = ruled.agg(F.count("ruled").alias("n")).first().n
    seeds = (ruled.filter("ruled is not null").groupBy("host", "ruled").agg(F.count("*").alias("k"))
             .select(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"),
                     "host", (F.col("k") / F.lit(total)).alias("seed")))
    ranks = propagate(stored(host_edges(placed), "host_edges"), seeds)
    scores = stored(ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("value")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("value")).otherwise(0.0)).alias("distrust")),
        "host_scores")
    zero = F.lit(0.0)
    out = ruled.join(scores, "host", "left").withColumns(
        {"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    by_score = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", "rule",
                      F.coalesce("ruled", by_score).alias("verdict"), "trust", "distrust")


@query("op4_url_filter")
def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
