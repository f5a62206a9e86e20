"""The rounds of the decomposition move one row per chunk and gram, never one per posting."""

import numpy as np

from fieldseq.operators import latent


def test_chunks_give_the_same_vectors_and_meet_a_gram_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.random((90, 12)) * (rng.random((90, 12)) < 0.6)
    m[:, 0] = 1.0
    postings = spark.createDataFrame([(f"u{i}", f"g{j}", float(m[i, j])) for i in range(90) for j in range(12) if m[i, j]],
                                     "uid string, gram string, weight double")
    stored, tables = latent.written, {}

    def noted(df, name):
        tables.setdefault(name, []).append(stored(df, name))
        return tables[name][-1]
    monkeypatch.setattr(latent, "written", noted)
    cut = latent.fit(postings, rank=2, rounds=3, chunk_rows=100)
    whole = latent.fit(postings, rank=2, rounds=3)
    assert np.allclose(cut.singular, whole.singular, rtol=1e-9)
    sizes = [(t.select("chunk").distinct().count(), t.count()) for t in tables["needed"]]
    assert sizes[0][0] > 1 and sizes[1][0] == 1
    assert all(rows <= 12 * chunks for chunks, rows in sizes) and sizes[0][1] < postings.count()
    assert tables["needed"][0].filter("chunk is null or number is null").count() == 0
    found = {r.gram: np.array(r.v) for r in cut.grams.collect()}
    own = {r.uid: np.array(r.v) for r in cut.items.collect()}
    expected = m @ np.array([found[f"g{j}"] for j in range(12)])
    assert len(own) == 90 and np.allclose([own[f"u{i}"] for i in range(90)], expected, atol=1e-9)
