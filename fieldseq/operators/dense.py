"""Exact nearest vectors by cosine, for a table of query vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.operators import predicate_index
from fieldseq.operators.skew import stacked, top_k
from fieldseq.sources.tables import written
from fieldseq.spec import ZONES

POOL = 50
SCORE_DIGITS = 9
# Numbers in the query matrix that every task may hold (8 bytes each).
MATRIX_CELLS = 8_000_000
# Rows of kept results (queries times k) that every task may hold.
KEPT_ROWS = 2_000_000
# Query columns scored against a batch of items at a time.
TILE = 256
# Vectors per side of one block pair when the query side is too large for that.
BLOCK_ROWS = 20_000
# Most balls the items are dealt to (their centres go to all tasks), and items per ball below that.
BALLS = 1024
BALL_ROWS = 500
# Far more than cosines lose to rounding, to scores of SCORE_DIGITS digits included.
_SLACK = 4e-9


def unit(vector: Column) -> Column:
    """Vector scaled to length 1."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(vector, lambda v: v / norm)


def _unit_rows(vectors: Iterable) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not all zero, all parts finite."""
    norm = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v)
    return F.coalesce((norm > 0) & (norm < F.lit(float("inf"))), F.lit(False))


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best(sims: np.ndarray, first: int, ids: np.ndarray, k: int, barred: np.ndarray | None) -> Hits:
    """Best k items for every query of a tile: query numbers, ids and scores.

    Rows of `sims` are items, columns queries; ties at the k-th place are kept for
    `_merged` to cut by id.
    """
    sims = np.round(sims, SCORE_DIGITS)
    if barred is not None:
        sims[barred] = -np.inf
    if len(sims) > k:
        bars = np.partition(sims, len(sims) - k, axis=0)[len(sims) - k]
        near = sims >= bars[None, :]
    else:
        near = np.ones(sims.shape, bool)
    rows, columns = np.nonzero(near & np.isfinite(sims))
    return columns + first, ids[rows], sims[rows, columns]


def _merged(parts: list[Hits], k: int) -> Hits:
    """The best k of several lists for every query, equal scores by id."""
    q, i, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], i[keep], s[keep]


def nearest(queries: DataFrame, items: DataFrame, k: int = POOL, query_id: str = "qid",
            item_id: str = "uid", vector: str = "embedding", exclude: str | None = None,
            allowed: str | None = None, matrix_cells: int = MATRIX_CELLS,
            gated: bool = False) -> DataFrame:
    """Best k items for each query vector: (qid, id, score, 0-based rank).

    Items and queries whose vector is null, zero or not finite take no part. `exclude` names a query column with one
    item id to leave out; `allowed` names an item column with an array of the
    query ids the item may be returned for; with `gated`, queries and items carry the
    columns of a predicate index, which decide that.

    While the query matrix is counted to be small it travels to the tasks, and
    the items are scanned once where they lie: no shuffle but that of the best k
    per task. A larger query table meets only the balls of items in its reach.
    """
    items = items.filter(usable(F.col(vector)))
    queries = queries.filter(usable(F.col(vector)))
    q_type, i_type = queries.schema[query_id].dataType, items.schema[item_id].dataType
    out = T.StructType([T.StructField(query_id, q_type), T.StructField(item_id, i_type),
                        T.StructField("score", T.DoubleType())])
    q_cols = [query_id, vector] + ([exclude] if exclude else []) + (
        ["needs", "min_xg", "min_events"] if gated else [])
    i_cols = [item_id, vector] + ([allowed] if allowed else []) + (
        ["held", "xg_sum", "n_events"] if gated else [])
    width = queries.select(F.max(F.size(vector))).first()[0] or 1
    fit = max(1, min(matrix_cells // width, KEPT_ROWS // k))
    head = queries.select(*q_cols).limit(fit + 1).toPandas()
    names = (query_id, item_id, vector, exclude, allowed, gated)
    if len(head) <= fit:
        found = _scan(head, items.select(*i_cols), k, names, out)
    else:
        found = _balls(queries.select(*q_cols), items.select(*i_cols), k, names, out)
    return top_k(found, [query_id], [F.desc("score"), F.asc(item_id)], k)


def _may(batch: pd.DataFrame, allowed: str, qids: np.ndarray) -> np.ndarray:
    """Items times queries: whether the item may answer the query."""
    lists = list(batch[allowed])
    flat = np.concatenate([np.asarray(x, dtype=qids.dtype) for x in lists])
    order = np.argsort(qids)
    at = np.minimum(np.searchsorted(qids, flat, sorter=order), len(qids) - 1)
    known = qids[order[at]] == flat
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    out = np.zeros((len(lists), len(qids)), bool)
    out[rows[known], order[at[known]]] = True
    return out


Names = tuple[str, str, str, str | None, str | None, bool]


def _meet(q: pd.DataFrame, matrix: np.ndarray, batch: pd.DataFrame, k: int, names: Names) -> Hits:
    query_id, item_id, vector, exclude, allowed, gated = names
    ids, qids = batch[item_id].to_numpy(), q[query_id].to_numpy()
    vectors = _unit_rows(batch[vector])
    may = _may(batch, allowed, qids) if allowed else None
    parts = []
    for start in range(0, len(qids), TILE):
        tile = slice(start, start + TILE)
        barred = ~may[:, tile] if allowed else None
        if gated:
            barred = ~predicate_index.may(batch, q.iloc[tile])
        if exclude:
            own = ids[:, None] == q[exclude].to_numpy()[None, tile]
            barred = own if barred is None else barred | own
        parts.append(_best(vectors @ matrix[tile].T, start, ids, k, barred))
    return _merged(parts, k)


def _frame(hits: Hits, qids: np.ndarray, query_id: str, item_id: str) -> pd.DataFrame:
    return pd.DataFrame({query_id: qids[hits[0]], item_id: hits[1], "score": hits[2]})


def _scan(q: pd.DataFrame, items: DataFrame, k: int, names: Names, out: T.StructType) -> DataFrame:
    query_id, item_id, vector = names[:3]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if q.empty:
            return
        matrix, kept = _unit_rows(q[vector]), []
        for batch in batches:
            if not batch.empty:
                kept.append(_meet(q, matrix, batch, k, names))
                kept = [_merged(kept, k)]
        if kept:
            yield _frame(kept[0], q[query_id].to_numpy(), query_id, item_id)

    return items.mapInPandas(run, out)


# --- balls of items -------------------------------------------------------------------

def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ centres.T)))


def nearest_balls(rows: np.ndarray, centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """[query, ball]: the closest balls that together hold at least k items."""
    order = np.argsort(_distances(rows, centres), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    out = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(out, order, held - sizes[order] < k, axis=1)
    return out & (sizes > 0)


def balls_in_reach(rows: np.ndarray, centres: np.ndarray, radii: np.ndarray, least: np.ndarray) -> np.ndarray:
    """[query, ball]: whether any item of the ball can score `least` or more.

    On the unit sphere a cosine is 1 - d^2 / 2, and no item of a ball is closer than its
    centre less its radius.
    """
    apart = np.maximum(0.0, _distances(rows, centres) - radii - _SLACK)
    return 1.0 - apart * apart / 2.0 + _SLACK >= least[:, None]


def _balls(queries: DataFrame, items: DataFrame, k: int, names: Names, out: T.StructType) -> DataFrame:
    """Queries look into the balls closest to them first; what they find there decides which
    other balls are in reach. Balls are cut into blocks of items and of visiting queries.

    Centres are items with the smallest hash of their id, at most BALLS; they decide how much
    is skipped, never what is found.
    """
    query_id, item_id, vector = names[:3]
    spark = items.sparkSession
    n = items.count()
    if not n:
        return spark.createDataFrame([], out)
    some = items.select(vector).orderBy(F.xxhash64(item_id), item_id).limit(
        min(BALLS, -(-n // BALL_ROWS))).toPandas()
    centres = _unit_rows(some[vector])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                apart = _distances(_unit_rows(batch[vector]), centres)
                yield batch.assign(ball=apart.argmin(axis=1), apart=apart.min(axis=1))

    kind = T.StructType([*items.schema, T.StructField("ball", T.IntegerType()), T.StructField("apart", T.DoubleType())])
    placed = written(items.mapInPandas(place, kind), "balls")
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("ball").agg(F.count("*").alias("n"), F.max("apart").alias("r")).collect():
        sizes[r.ball], radii[r.ball] = r.n, r.r

    def visits(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    rows = _unit_rows(batch[vector])
                    wanted = nearest_balls(rows, centres, sizes, k)
                    if not first:
                        least = batch["_least"].fillna(-np.inf).to_numpy(np.float64)
                        wanted = ~wanted & balls_in_reach(rows, centres, radii, least) & (sizes > 0)
                    query, ball = np.nonzero(wanted)
                    yield batch.drop(columns="_least").iloc[query].assign(ball=ball)
        return run

    def met(asked: DataFrame, first: bool) -> DataFrame:
        visiting = written(asked.mapInPandas(visits(first), T.StructType(
            [*queries.schema, T.StructField("ball", T.IntegerType())])), "visits")
        guests = np.ones(len(centres), np.int64)
        for r in visiting.groupBy("ball").agg(F.count("*").alias("n")).collect():
            guests[r.ball] = r.n
        cut = {name: F.element_at(F.array(*[F.lit(int(max(1, -(-v // BLOCK_ROWS)))) for v in numbers]), F.col("ball") + 1)
               for name, numbers in (("block", sizes), ("part", guests))}
        left = (visiting.withColumn("part", F.pmod(F.xxhash64(query_id), cut["part"]).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), cut["block"] - 1))))
        right = (placed.drop("apart").withColumn("block", F.pmod(F.xxhash64(item_id), cut["block"]).cast("int"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), cut["part"] - 1))))

        def run(q: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
            if q.empty or batch.empty:
                return pd.DataFrame({query_id: [], item_id: [], "score": []})
            return _frame(_meet(q, _unit_rows(q[vector]), batch, k, names), q[query_id].to_numpy(), query_id, item_id)

        place_of = ["ball", "block", "part"]
        right = right.join(left.select(*place_of).distinct(), place_of, "left_semi")
        return left.groupBy(*place_of).cogroup(right.groupBy(*place_of)).applyInPandas(run, out)

    none = F.lit(None).cast("double")
    close = written(top_k(met(queries.withColumn("_least", none), True), [query_id],
                          [F.desc("score"), F.asc(item_id)], k).drop("rank"), "close")
    reached = (close.groupBy(query_id).agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
               .filter(F.col("_n") == k).drop("_n"))
    return stacked([close, met(queries.join(reached, query_id, "left"), False)])


def zone_profile(zone_path: Column) -> Column:
    """How often each zone of the grid is visited, as a vector."""
    zones = F.split(zone_path, " ")
    return F.array(*[F.size(F.filter(zones, _equals(z))).cast("double") for z in ZONES])


def _equals(name: str):
    return lambda z: z == name


def with_vectors(items: DataFrame, vectors: DataFrame, item_id: str = "uid",
                 vector: str = "embedding") -> DataFrame:
    """Items with their vector set anew; items without one get null."""
    return items.drop(vector).join(vectors.select(item_id, vector), item_id, "left")


def token_vectors(possessions: DataFrame, size: int = 64, seed: int = 7, min_count: int = 2,
                  item_id: str = "uid") -> DataFrame:
    """Vectors trained on the token lines themselves, for corpora that bring none."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    docs = possessions.select(item_id, F.split("token_string", " ").alias("_tokens"))
    model = Word2Vec(vectorSize=size, seed=seed, minCount=min_count, inputCol="_tokens",
                     outputCol="_vector").fit(docs)
    vectors = model.transform(docs).select(
        item_id, vector_to_array("_vector").alias("embedding"))
    long = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v) > 0
    return vectors.select(item_id, F.when(long, unit(F.col("embedding"))).alias("embedding"))
