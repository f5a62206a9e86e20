"""Lloyd clustering on an integer grid with ns-bounds.

A vector keeps, for each centroid, its exact squared distance and the round that was
measured in. The history of centroids is kept too, so a bound is loosened by how far the
centroid now is from where it was then (the norm of its whole displacement), which is
never more than the sum of its steps. Only centroids whose lower bound reaches the upper
bound of the vector's own are measured again, exactly, in integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.llm.base import discard, kept_table, query, stored, table

DIMS, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Grid coordinates end at this size, so that squared distances of up to 256 dimensions fit in a long.
LARGEST = 1 << 26
_SLACK = 1e-9


def on_grid(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>): vectors with exactly `dims` finite components, as floor(scale * component)."""
    v = F.col("embedding")
    finite = F.forall(v, lambda e: F.coalesce(
        ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    held = vectors.select("vec_id", "embedding").filter((F.size(v) == dims) & finite)
    return held.select("vec_id", F.transform(v, lambda e: F.floor(F.least(F.lit(float(LARGEST)), F.greatest(
        F.lit(float(-LARGEST)), e.cast("double") * scale))).cast("int")).alias("x"))


def first_centroids(grid: DataFrame, k: int = K, seed: int = 1) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256; fewer when there are fewer."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = grid.select(order.alias("o"), "x").orderBy(F.col("o").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[round, centroid]: distance of a centroid in that round from where it is now, rounded up."""
    now = history[-1].astype(np.float64)
    return np.array([np.sqrt(((now - then) ** 2).sum(axis=1)) for then in history]) * (1 + _SLACK)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _measured(x: np.ndarray, centroids: np.ndarray, squares: np.ndarray, rounds: np.ndarray,
              wanted: np.ndarray, now: int) -> None:
    """Fill in the exact squared distances of the wanted (vector, centroid) pairs."""
    for j in range(len(centroids)):
        rows = np.flatnonzero(wanted[:, j])
        apart = x[rows] - centroids[j]
        squares[rows, j] = np.einsum("ij,ij->i", apart, apart)
        rounds[rows, j] = now


def reassign(x: np.ndarray, own: np.ndarray, squares: np.ndarray, rounds: np.ndarray,
             history: list[np.ndarray], moved: np.ndarray) -> int:
    """Nearest centroids of the newest round, in place; the number of distances measured.

    Equal distances go to the smaller number: a centroid is passed over only if it is
    strictly further away for certain.
    """
    now, k, at = len(history) - 1, len(history[-1]), np.arange(len(x))
    lower = np.sqrt(squares) * (1 - _SLACK) - moved[rounds, np.arange(k)]
    upper = np.sqrt(squares[at, own]) * (1 + _SLACK) + moved[rounds[at, own], own]
    lower[at, own] = np.inf
    failed = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    if not len(failed):
        return 0
    fx, fs, fr, fo = x[failed], squares[failed], rounds[failed], own[failed]
    mine = np.zeros((len(failed), k), dtype=bool)
    mine[np.arange(len(failed)), fo] = True
    _measured(fx, history[-1], fs, fr, mine & (fr != now), now)
    upper = np.sqrt(fs[mine]) * (1 + _SLACK)
    again = (lower[failed] <= upper[:, None]) & (fr != now)
    _measured(fx, history[-1], fs, fr, again, now)
    fresh = np.where(fr == now, fs, np.iinfo(np.int64).max)
    squares[failed], rounds[failed], own[failed] = fs, fr, fresh.argmin(axis=1)
    return int(mine.sum() + again.sum())


def _assign(history: list[np.ndarray], final: bool):
    """Reassign the vectors of a round; in the first one every distance is measured."""
    k, dims = history[-1].shape
    now, moved = len(history) - 1, displacements(history)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dims, np.int64)
            n = len(x)
            if now:
                own = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                squares = _matrix(batch.column("squares"), k, np.int64)
                rounds = _matrix(batch.column("rounds"), k, np.int16)
                measured = reassign(x, own, squares, rounds, history, moved)
            else:
                squares, rounds = np.empty((n, k), np.int64), np.zeros((n, k), np.int16)
                _measured(x, history[0], squares, rounds, np.ones((n, k), bool), 0)
                own, measured = squares.argmin(axis=1), n * k
            columns = {"vec_id": batch.column("vec_id"), "cluster": pa.array(own, pa.int32())}
            if final:
                apart = x - history[-1][own]
                columns["distance"] = pa.array(np.einsum("ij,ij->i", apart, apart))
            else:
                ends = pa.array(np.arange(n + 1) * k, pa.int32())
                columns |= {"x": batch.column("x"),
                            "squares": pa.ListArray.from_arrays(ends, pa.array(squares.ravel())),
                            "rounds": pa.ListArray.from_arrays(ends, pa.array(rounds.ravel(), pa.int16()))}
            counted = np.zeros(n, np.int64)
            counted[0] = measured
            columns["measured"] = pa.array(counted)
            yield pa.RecordBatch.from_pydict(columns)
    return apply


def _sums(k: int, dims: int):
    """Count and componentwise sums of the clusters of a partition."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("x"), dims, np.int64)
            counts += np.bincount(own, minlength=k)
            for j in np.unique(own):
                sums[j] += x[own == j].sum(axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some]),
                                          "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})
    return apply


def moved_centroids(members: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means of (cluster, x); clusters without members stay where they are."""
    k, dims = centroids.shape
    parts = members.select("cluster", "x").mapInArrow(_sums(k, dims), "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            seed: int = 1) -> tuple[DataFrame, list[np.ndarray]]:
    """Assignments after `rounds` rounds, and the centroids of every round.

    Assignments are vec_id, cluster, distance (squared) and measured: the distances measured
    for the vector's batch in the last step, on its first row, 0 on the others. Vectors with
    another number of components, null or non-finite ones have no row. Components beyond
    2^26 grid steps are held there. Repeated rows are vectors of their own; a null vec_id
    takes part and comes last among first centroids, equal hashes go by components. With
    fewer vectors than k there are as many centroids as vectors; without any, no rows.

    The driver holds (rounds + 1) * k * dims numbers, the history, whatever the number of
    vectors; a vector carries k distances. The table of a round is dropped after the next.
    """
    grid, at = kept_table(on_grid(vectors, dims, scale), "grid")
    start = first_centroids(grid, k, seed)
    if not len(start):
        return grid.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
                           F.lit(0).cast("long").alias("measured")), [np.zeros((0, dims), np.int64)]
    history = [start]
    kind = "vec_id long, cluster int, x array<int>, squares array<long>, rounds array<smallint>, measured long"
    for _ in range(rounds):
        state, path = kept_table(grid.mapInArrow(_assign(list(history), False), kind), "assigned")
        discard(grid.sparkSession, at)
        grid, at = state, path
        history.append(moved_centroids(state, history[-1]))
    last = stored(grid.mapInArrow(_assign(history, True), "vec_id long, cluster int, distance long, measured long"),
                  "assigned")
    discard(grid.sparkSession, at)
    return last, history


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia (null beyond a long) and the SHA-256 of the centroid.

    The joined table has one row per centroid.
    """
    per: Column = F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(per).collect()}
    total, top = sum(sums.values()), 2 ** 63 - 1
    named = [(j, s if s <= top else None, total if total <= top else None,
              hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
             for j, s in sums.items()]
    small = assigned.sparkSession.createDataFrame(
        named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster")


def _oracle(k: int, rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
  d{r} as (select rid, j, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c{r}.x[i]) * (v.x[i] - c{r}.x[i]))) as d
         from v cross join c{r}),
  a{r} as (select rid, arg_min(j, d * {k} + j) as j, min(d) as d from d{r} group by rid)""")
        if r < rounds:
            steps.append(f"""
  m{r} as (select j, i, sum(v.x[i])::bigint as s, count(*) as n from a{r} join v using (rid), range(1, 65) as t(i) group by j, i),
  f{r} as (select j, list((s - ((s % n) + n) % n) // n order by i) as x from m{r} group by j),
  c{r + 1} as (select c{r}.j, coalesce(f{r}.x, c{r}.x) as x from c{r} left join f{r} using (j))""")
    return f"""
  with v as materialized (
    select row_number() over () as rid, vec_id, list_transform(embedding, lambda e: floor(64 * cast(e as double))::bigint) as x
    from embeddings where len(embedding) = 64
      and list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e)))),
  c0 as (select row_number() over (order by sha256('1:' || vec_id) nulls last, x) - 1 as j, x from v
         qualify j < {k}),{",".join(steps)}
  select vec_id, j::int as cluster, d::bigint as distance, (sum(d) over (partition by j))::bigint as cluster_inertia,
    (sum(d) over ())::bigint as inertia,
    sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
  from a{rounds} join v using (rid) join c{rounds} using (j)"""


@query("op11_ns_bound_clusters", _oracle(K, ROUNDS))
def op11_ns_bound_clusters(spark, sf_dir: str) -> DataFrame:
    assigned, history = cluster(table(spark, sf_dir, "embeddings"))
    return with_inertia(assigned, history[-1]).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
