"""Clustering with ns-bounds against plain Lloyd rounds, with odd rows."""

import hashlib
import math
import random

import numpy as np

from fieldseq.llm import centroids
from fieldseq.llm.centroids import cluster, with_inertia

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


def plain(rows, k, rounds, dims, scale=64):
    """(vec_id, components) to (cluster, squared distance), in Python integers."""
    kept = [(i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(scale * x))) for x in v])
            for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    now = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(now)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                now[j] = [sum(column) // len(mine) for column in zip(*mine)]
    return sorted((-1 if i is None else i, *reversed(nearest(v))) for i, v in kept), now


def rows_of(n, dims, seed, spread=0.2):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    return [(i, [m + rnd.gauss(0, spread) for m in rnd.choice(middles)]) for i in range(n)]


def got(found):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.collect())


def test_against_plain_rounds_with_odd_vectors(spark):
    rows = rows_of(300, 6, 5)
    nan, inf = float("nan"), float("inf")
    rows += [(300 + i, rows[0][1]) for i in range(20)]  # equal vectors
    rows += [rows[1], rows[1], (None, rows[2][1]), (400, None), (401, []), (402, [0.0] * 6), (403, [nan] + [1.0] * 5),
             (404, [inf] * 6), (405, [None] + [1.0] * 5), (406, [1.0] * 7), (407, [1e300] * 6), (408, [-1e300] * 6)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    for k, rounds in ((7, 6), (4, 0), (1, 2)):
        want, middles = plain(rows, k, rounds, 6)
        found, history = cluster(df, k, rounds, dims=6)
        assert got(found) == want and len(history) == rounds + 1
        assert history[-1].tolist() == middles


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]  # only two places for 5 centroids
    want, _ = plain(rows, 5, 3, 2)
    assert got(cluster(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), 5, 3, dims=2)[0]) == want


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], "", 0), (2, [0.1, 0.2], "", 0), (3, [9.0], "", 0)], SCHEMA)
    assert [r[2] for r in got(cluster(df, 16, 3, dims=2)[0])] == [0, 0]
    found, history = cluster(df.filter("vec_id > 2"), 16, 3, dims=2)
    assert found.count() == 0 and with_inertia(found, history[-1]).count() == 0


def test_bounds_spare_distances_and_displacements_are_of_sums(spark):
    rows = rows_of(2000, 8, 9, 0.1)
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    want, _ = plain(rows, 16, 8, 8)
    found, history = cluster(df, 16, 8, dims=8)
    assert got(found) == want
    measured = sum(r.measured for r in found.collect())
    assert measured < 2000 * 16 * 0.3
    steps = [np.sqrt(((a - b) ** 2).sum(axis=1)) for a, b in zip(history[1:], history[:-1])]
    loosened = centroids.displacements(history)
    assert (loosened[0] <= sum(steps) + 1e-6).all() and (loosened[0] < sum(steps) - 1e-6).any()
    assert (loosened[-1] == 0).all()


def test_stale_bounds_stay_exact():
    """Bounds measured in different rounds, against measuring everything."""
    rng = np.random.default_rng(2)
    x = rng.integers(-60, 60, (500, 4))
    history = [rng.integers(-60, 60, (9, 4))]
    squares, rounds = np.empty((500, 9), np.int64), np.zeros((500, 9), np.int16)
    centroids._measured(x, history[0], squares, rounds, np.ones((500, 9), bool), 0)
    own = squares.argmin(axis=1)
    for _ in range(12):
        history.append(history[-1] + rng.integers(-4, 5, (9, 4)))
        centroids.reassign(x, own, squares, rounds, history, centroids.displacements(history))
        full = ((x[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (own == full.argmin(axis=1)).all()
    assert len(np.unique(rounds)) > 3


def test_inertia_beyond_a_long_is_null(spark):
    big = 2 ** 62
    df = spark.createDataFrame([(1, 0, big), (2, 0, big), (3, 1, 5)], "vec_id long, cluster int, distance long")
    got = {r.vec_id: r for r in with_inertia(df, np.zeros((2, 3), np.int64)).collect()}
    assert (got[1].cluster_inertia, got[3].cluster_inertia, got[3].inertia) == (None, 5, None)
    assert got[1].centroid_sha256 == hashlib.sha256(b"0,0,0").hexdigest()
