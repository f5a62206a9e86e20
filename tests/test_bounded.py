"""Pruned sparse and dense rankings against full ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_retrieval import POSS, WANTED, filter_table, possession_rows

from fieldseq.operators import bounded, dense, predicate_index, sparse

def words_of(column="token_string"):
    return F.split(column, " ")


def rows_of(ranking, item="uid"):
    return sorted((r.qid, r["rank"], r[item], r.score) for r in ranking.collect())


@pytest.fixture(scope="module")
def topics(spark):
    """Documents of 40 topics that share a few words."""
    rnd = random.Random(7)
    rows = []
    for i in range(800):
        t = i % 40
        words = [f"t{t}w{rnd.randint(0, 9)}" for _ in range(12)] + rnd.choices(["the", "a", "of"], k=3)
        rows.append((i, " ".join(words)))
    rows += [(900 + i, rows[5][1]) for i in range(9)]
    return spark.createDataFrame(rows, "uid int, text string")


def test_bounded_search_reads_few_postings_and_gives_all(spark, topics):
    words = F.split("text", " ")
    index = sparse.fit_index(topics, "uid", words).shared()
    asked = spark.createDataFrame([(f"q{t}", f"t{t}w1 t{t}w2 t{t}w3 t{t}w4 the") for t in range(20)]
                                  + [("same", topics.filter("uid = 5").first().text), ("no", "unknown"), ("the", "the of")],
                                  "qid string, text string")
    vectors = sparse.query_vectors(asked, index.vocab, words).cache()
    want = {k: rows_of(sparse.rank(sparse.scores(vectors, index), "uid", k)) for k in (5, 900)}
    blocks = bounded.in_blocks(index, 20)
    assert rows_of(bounded.best(vectors, blocks, 5)) == want[5]
    assert rows_of(bounded.best(vectors, blocks, 900)) == want[900]  # nobody has k: all blocks
    assert rows_of(bounded.best(vectors, bounded.in_blocks(index, 10 ** 6), 5)) == want[5]
    _, first, later = bounded.visits(vectors, blocks, 5)
    read = sum(r.matches for r in first.collect()) + sum(r.matches for r in later.collect())
    assert read < sum(r.matches for r in bounded.bounds(vectors, blocks).collect()) / 2
    true = {(r.qid, r.uid): r.score for r in sparse.scores(vectors, index).collect()}
    placed = {r.uid: r.block for r in blocks.postings.select("uid", "block").distinct().collect()}
    limit = {(r.qid, r.block): r.bound for r in bounded.bounds(vectors, blocks).collect()}
    assert len(placed) == 809 and len(set(placed.values())) > 20
    assert all(score <= limit[q, placed[u]] + 1e-9 for (q, u), score in true.items())


def test_bounded_search_keeps_filters(spark):
    items = spark.createDataFrame(possession_rows(150, 2), POSS)
    index = sparse.fit_index(items, "uid", words_of()).shared()
    hint = " ".join(r.token_string for r in items.limit(3).collect())
    asked = filter_table(spark, WANTED, "hint string", lambda q: (hint,))
    wanted = predicate_index.build(asked)
    held = wanted.probe(items).cache()
    vectors = wanted.asked(sparse.query_vectors(asked, index.vocab, F.split("hint", " "))).cache()
    for k in (3, 40):
        want = rows_of(sparse.rank(sparse.scores(vectors, index, held=held), "uid", k))
        assert rows_of(bounded.best(vectors, bounded.in_blocks(index, 10), k, held=held)) == want


def test_hybrid_with_blocks_gives_the_same_fused_ranking(spark):
    from fieldseq.operators import fuse
    items = spark.createDataFrame(possession_rows(90, 5), POSS)
    index = sparse.fit_index(items, "uid", words_of()).shared()
    vectors = items.select("uid", dense.zone_profile(F.col("zone_path")).alias("embedding"))
    asked = filter_table(spark, WANTED, "hint string, embedding array<double>", lambda q: ("PASS@M-C SHOT@F-C", [1.0] * 15))
    plain = fuse.hybrid(asked, items, index, words_of("hint"), vectors, 9, pool=12)["fused"]
    pruned = fuse.hybrid(asked, items, index, words_of("hint"), vectors, 9, pool=12, blocks=bounded.in_blocks(index, 8))
    assert rows_of(pruned["fused"]) == rows_of(plain)


def test_balls_skip_what_is_out_of_reach_only():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 12))
    rows = np.concatenate([m + rng.normal(size=(40, 12)) * 0.1 for m in middles])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres = rows[::40]
    apart = dense._distances(rows, centres)
    ball = apart.argmin(axis=1)
    sizes = np.bincount(ball, minlength=30)
    radii = np.array([apart[ball == b, b].max() for b in range(30)])
    asked = rows[::7]
    scores = asked @ rows.T
    least = np.sort(scores, axis=1)[:, -10]
    reached = dense.balls_in_reach(asked, centres, radii, least)
    query, item = np.nonzero(scores >= least[:, None])
    assert reached[query, ball[item]].all() and reached.mean() < 0.3
    close = dense.nearest_balls(asked, centres, sizes, 100)
    assert (close @ sizes >= 100).all() and close.sum(axis=1).max() <= 5


def test_pruned_vectors_with_ties_filters_and_exclusion(spark, monkeypatch):
    monkeypatch.setattr(dense, "BALL_ROWS", 20)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 15)
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(9, 5))
    data = [(f"1:{i}", [float(x) for x in middles[i % 9] + rng.normal(size=5) * 0.05]) for i in range(150)]
    data += [(f"2:{i}", data[i][1]) for i in range(30)]
    items = spark.createDataFrame(possession_rows(180, 4), POSS).withColumn("n", F.monotonically_increasing_id())
    ids = [r.uid for r in items.collect()]
    vectors = spark.createDataFrame([(u, v) for u, (_, v) in zip(ids, data)], "uid string, embedding array<double>")
    asked = filter_table(spark, WANTED, "embedding array<double>, seed string",
                         lambda q: (data[ord(q) % 40][1], ids[ord(q) % 40]))
    wanted = predicate_index.build(asked)
    gated = wanted.asked(asked)
    held = vectors.join(wanted.probe(items), "uid").cache()
    for k in (4, 60):
        full = rows_of(dense.nearest(gated, held, k, exclude="seed", gated=True))
        assert rows_of(dense.nearest(gated, held, k, exclude="seed", gated=True, matrix_cells=1)) == full and full
    everyone = held.select(F.col("uid").alias("qid"), "embedding")
    assert rows_of(dense.nearest(everyone, held, 6, matrix_cells=1)) == rows_of(dense.nearest(everyone, held, 6))
