"""Rank fusion, hybrid search, more-like-this and shape search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.functions import grammar as G
from fieldseq.operators import bounded, dense, filters, predicate_index, shapes, sparse
from fieldseq.operators.skew import spread_join, stacked, top_k
from fieldseq.sources.tables import written

RRF_K = 60
POOL = 50
LIMIT = 20


def reciprocal(rank: Column, k: int = RRF_K) -> Column:
    """Weight of a 0-based rank."""
    return F.lit(1.0) / (rank + (k + 1))


def fuse(rankings: Sequence[DataFrame], item_id: str = "uid", limit: int = LIMIT,
         query_id: str = "qid") -> DataFrame:
    """Merge rankings by rank alone. A single non-empty list keeps its order."""
    weighted = stacked([r.select(query_id, item_id, reciprocal(F.col("rank")).alias("w"))
                        for r in rankings])
    fused = weighted.groupBy(query_id, item_id).agg(F.sum("w").alias("score"))
    return top_k(fused, [query_id], [F.desc("score"), F.asc(item_id)], limit)


def pooled(rankings: Mapping[str, DataFrame], item_id: str = "uid",
           query_id: str = "qid") -> DataFrame:
    """Rankings stacked with the name of their ranker."""
    parts = [r.select(query_id, F.lit(name).alias("ranker"), item_id, "rank", "score")
             for name, r in rankings.items()]
    return stacked(parts)


def hybrid(queries: DataFrame, items: DataFrame, index: sparse.SparseIndex, words: Column,
           vectors: DataFrame | None = None, limit: int = LIMIT, pool: int = POOL,
           use_filters: bool = True, shared: bool = False,
           blocks: bounded.BlockIndex | None = None) -> dict[str, DataFrame]:
    """Sparse, dense and fused rankings for a table of queries.

    `queries` has qid, what `words` reads, `filters` (when used) and an
    `embedding` when `vectors` (item id, embedding) are given. Filters decide
    membership for both rankers before anything is scored: a predicate index of the
    query table is probed once per item (`held`, one row per item), and queries must
    have a `filters` column. With `blocks`, the same index in blocks, the sparse ranking
    scores only blocks that can reach the top. With `shared`, the single rankings (at most `pool` rows per query) are written to
    the shared folder once, for callers that read them besides the fused one.
    """
    item_id = index.id_col
    asked = held = None
    if use_filters:
        if "filters" not in queries.columns:
            raise ValueError("queries without `filters`; pass use_filters=False to search all items")
        queries = written(queries, "queries")  # read for the index, the grams and the vectors
        asked = predicate_index.build(queries)
        held = written(asked.probe(items, item_id), "held")
    grams = sparse.query_vectors(queries, index.vocab, words)
    grams = grams if asked is None else asked.asked(grams)
    if blocks is not None:
        found = {"sparse": bounded.best(written(grams, "grams"), blocks, pool, held=held)}
    else:
        pairs = sparse.scores(grams, index, small=sparse.is_small(queries, words), held=held)
        found = {"sparse": sparse.rank(pairs, item_id, pool)}
    if vectors is not None:
        found["dense"] = dense.nearest(
            queries if asked is None else asked.asked(queries), _with_held(vectors, held, item_id),
            pool, item_id=item_id, gated=held is not None)
    if shared:
        found = {name: written(ranking, name) for name, ranking in found.items()}
    found["fused"] = fuse(list(found.values()), item_id, limit)
    if asked is not None:
        found["held"] = held
        found["needs"] = asked.needs
    return found


def _with_held(vectors: DataFrame, held: DataFrame | None, item_id: str) -> DataFrame:
    return vectors if held is None else vectors.select(item_id, "embedding").join(held, item_id)


def similar(seeds: DataFrame, index: sparse.SparseIndex, vectors: DataFrame | None = None,
            limit: int = LIMIT, pool: int = POOL, items: DataFrame | None = None
            ) -> dict[str, DataFrame]:
    """More like each seed: its own stored vectors are the query, itself is left out.

    `seeds` has `qid` and the id column of the index, and `filters` when the filters of
    a seed are to hold for what is returned; these are read from `items`. Unknown seeds
    give no rows; `unknown_seeds` lists them.
    """
    item_id = index.id_col
    asked = held = None
    if "filters" in seeds.columns:
        if items is None:
            raise ValueError("filtered seeds need the items their filters are about")
        seeds = written(seeds, "seeds")
        asked = predicate_index.build(seeds)
        held = written(asked.probe(items, item_id), "held")
        seeds = asked.asked(seeds)
    own = seeds.select("qid", F.col(item_id).alias("_seed"))
    grams = sparse.seed_vectors(index, seeds)
    pairs = sparse.scores(grams if asked is None else asked.asked(grams), index, held=held)
    pairs = spread_join(pairs, own, ["qid"], F.col(item_id))
    pairs = pairs.filter(F.col(item_id) != F.col("_seed")).drop("_seed")
    found = {"sparse": sparse.rank(pairs, item_id, pool)}
    if vectors is not None:
        near = (seeds.join(vectors.select(item_id, "embedding"), item_id)
                .withColumnRenamed(item_id, "_seed"))
        found["dense"] = dense.nearest(near, _with_held(vectors, held, item_id), pool, item_id=item_id,
                                       exclude="_seed", gated=held is not None)
    found["fused"] = fuse(list(found.values()), item_id, limit)
    return found


def unknown_seeds(seeds: DataFrame, index: sparse.SparseIndex) -> DataFrame:
    return seeds.join(index.postings.select(index.id_col).distinct(), index.id_col, "left_anti")


def hydrate(ranked: DataFrame, items: DataFrame, columns: Sequence[str], item_id: str = "uid",
            query_id: str = "qid") -> DataFrame:
    """Display columns for ranked ids; the rank column keeps the order."""
    keep = [c for c in columns if c != item_id]
    ranked = ranked.select(query_id, "rank", item_id, "score")
    return ranked.join(items.select(item_id, *keep), item_id) \
        .select(query_id, "rank", item_id, "score", *keep)


# --- shape search -------------------------------------------------------------------

def reduced_paths(possessions: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Zone path with repeats collapsed, as an array."""
    return possessions.select(
        "uid", "n_events", *extra,
        G.collapse_repeats(F.split("zone_path", " ")).alias("path"))


def collapse(zones: Sequence[str]) -> list[str]:
    return [z for i, z in enumerate(zones) if i == 0 or zones[i - 1] != z]


def shape_matches(possessions: DataFrame, drawings: Mapping[str, Sequence[str]],
                  wanted: Mapping[str, filters.Filters] | None = None) -> DataFrame:
    """All (qid, possession) pairs whose path holds the drawn zones in order.

    Shapes are part of the query text: each possession is looked at once and
    yields one row per shape it holds, so there is no join and no shuffle.
    """
    wanted = wanted or {}
    extra = [c for c in filters.FILTER_INPUTS if c != "n_events"]
    paths = reduced_paths(possessions, extra)
    tests = []
    for qid, zones in drawings.items():
        drawn = collapse(zones)
        holds = G.is_subsequence(F.array(*[F.lit(z) for z in drawn]), F.col("path"))
        coverage = F.lit(float(len(drawn))) / F.size("path")
        fits = wanted[qid].predicate() & holds if qid in wanted else holds
        tests.append(F.when(fits, F.struct(F.lit(qid).alias("qid"), coverage.alias("coverage"))))
    return (paths.select("uid", "n_events",
                         F.explode(F.array_compact(F.array(*tests))).alias("m"))
            .select("m.qid", "uid", "n_events", "m.coverage"))


def shape_search(possessions: DataFrame, drawings: Mapping[str, Sequence[str]],
                 wanted: Mapping[str, filters.Filters] | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """Possessions ranked by how much of their journey the drawn shape makes up."""
    return by_coverage(shape_matches(possessions, drawings, wanted), limit)


def shape_table_search(possessions: DataFrame, table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The same for a table of shapes (qid, zones[, filters]) of any size."""
    return by_coverage(shapes.matches(possessions, table), limit)


def by_coverage(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    ranked = top_k(found, ["qid"], [F.desc("coverage"), F.desc("n_events"), F.desc("uid")], limit)
    return ranked.withColumn("score", F.bround("coverage", 3))


def shape_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.count("*").alias("n_matched"))
