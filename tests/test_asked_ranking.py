"""Documents ranked where they lie, by the lengths all their grams give them, rank as the whole index has it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldseq.operators import asked, bounded, sparse

ASKED = [("q", "a b c"), ("r", "d zz a"), ("s", None), ("t", "nowhere"), ("u", "e e d e e")]


def words():
    return F.filter(F.split("text", " "), lambda w: w != "")


def corpus():
    pick = np.random.default_rng(3)
    texts = [" ".join(pick.choice(list("aaaabbcde") + ["rare", "x", "y"], n)) for n in pick.integers(0, 30, 60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "b d e"), (3, "a b c"), (7, None), (None, "a b"), (None, "c d"), (90, None)]
    return rows + [(100 + i, "a b c d") for i in range(5)]  # equal scores


@pytest.mark.parametrize("k, part, span, cells", [(4, 8 << 20, 4_000_000, 4_000_000), (50, 64, 40, 7)])
def test_ranking_is_that_of_the_whole_index(spark, monkeypatch, k, part, span, cells):
    monkeypatch.setattr(asked, "PART_BYTES", part)
    monkeypatch.setattr(asked, "RANGE_GRAMS", span)
    monkeypatch.setattr(asked, "SCORE_CELLS", cells)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    queries = spark.createDataFrame(ASKED, "qid string, text string")
    index = sparse.fit_index(docs, "doc_id", words())
    vectors = sparse.query_vectors(queries, index.vocab, words())
    want = sparse.rank(sparse.scores(vectors, index, small=True), "doc_id", k)
    got = bounded.best_asked(docs, "doc_id", words(), queries, words(), k)
    listed = [{(r.qid, r.doc_id, r["rank"], round(r.score, 8)) for r in df.collect()} for df in (want, got)]
    assert listed[0] == listed[1] and {r[0] for r in listed[0]} == {"q", "r", "u"}


def test_a_batch_leaves_one_row_per_range_of_its_grams(spark, monkeypatch):
    monkeypatch.setattr(asked, "PART_BYTES", 200)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    queries = spark.createDataFrame(ASKED, "qid string, text string")
    index = asked.AskedIndex(docs, "doc_id", words(), queries, words(), 2, 3)
    held = index._frequency().collect()
    assert len(held) <= index.packed.count() * index.ranges
    counts = sparse.term_counts(docs, "doc_id", words())
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    seen = sorted(n for r in held for n in asked._counts(bytes(r.df)).tolist())
    of_batch = [set(b.grams(3)[1].tolist()) for b in map(asked.Batch.of, (r.asDict() for r in index.packed.collect()))]
    assert len(seen) == sum(map(len, of_batch)) and max(seen) == df.agg(F.max("df")).first()[0]


def test_blocks_of_bytes_come_back():
    pick = np.random.default_rng(1)
    for n in (1, 2, 1000, 300_000):
        rising = np.unique(pick.integers(0, 2 ** 64, n, dtype=np.uint64))
        assert (asked._unsqueezed(asked._squeezed(rising)) == rising).all()
        counts = (pick.pareto(0.5, n) + 1).clip(0, 2 ** 31 - 1).astype(np.int32)
        assert (asked._counts(asked._few_bits(counts)) == counts).all()
        codes = np.minimum(counts, 2 ** 24 - 1)
        assert (asked._codes(asked._planes(codes)) == codes).all()
