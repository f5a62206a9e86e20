"""Vector join, n-gram join and components against brute force, with odd rows."""

import math
import random

import numpy as np

from fieldseq.llm import ngram_join
from fieldseq.llm.components import components
from fieldseq.llm.ngram_join import near_texts, one_of_each
from fieldseq.llm.vector_join import near_vectors


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    links += [(200, 201), (201, 200), (205, 203), (203, 204)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots_of({x for e in links for x in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = rng.normal(size=16)
        for _ in range(12):
            rows.append([base + rng.normal(size=16) * 0.12, c % 2])
    rows += [[rows[0][0].copy(), 0], [rows[0][0].copy(), 0], [rows[0][0] * 3, 0], [rows[0][0].copy(), 1]]
    data = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    n = len(data)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0),
           (n + 3, [None] + [1.0] * 15, 0), (n + 4, data[0][1], None), (n + 5, [], 0),
           (n + 6, data[0][1][:8], 0), (n + 7, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in data + odd],
                               "vec_id long, embedding array<double>, label int, rep string, n int")
    got = {r.vec_id: r for r in near_vectors(df, block=16).collect()}
    links = set()
    for i, a, la in data:
        for j, b, lb in data:
            if i != j and la == lb:
                if math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(
                        math.fsum(x * x for x in a) * math.fsum(y * y for y in b)) >= 0.98:
                    links.add((i, j))
    want = roots_of(range(n + 8), links)
    assert len(links) > 60 and len(got) == n + 8
    for i, r in got.items():
        assert r.n_links == sum(a == i for a, _ in links)
        assert r.component_id == want[i] and r.kept == (want[i] == i)
    assert near_vectors(df.filter("vec_id < 0")).count() == 0


def near_family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(n)]
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(n)] = rng.choice(words)
    return base, out


def test_texts_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for edits in range(9):
        for _ in range(4):
            a, b = near_family(rng, vocabulary, 70, edits)
            texts += [" ".join(a), " ".join(b)]
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))
              for _ in range(40)]
    texts += ["", None, "  \t ", "one two", "ONE  two", "one two three", texts[0], texts[0].upper(), "a " * 5000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string, uid int").repartition(3)
    df.write.mode("overwrite").parquet(path := f"{_folder()}/near")
    df = spark.read.parquet(path)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots_of(range(len(sets)), links)
    for stars, tile in ((0, 7), (1, 256), (2, 7)):  # without stars whole families are compared
        monkeypatch.setattr(ngram_join.family_links, "__defaults__", ((3, 4), tile))
        got = {r.doc_id: r for r in near_texts(df, stars=stars).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near_texts(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    text = "some words that make a text of nine words"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "other"), (2, "words apart")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in near_texts(df).collect())
    assert got == [(0, 0, 0), (0, 1, 5), (1, 1, 5), (1, 1, 5), (2, 2, 1), (2, 2, 1)]
    assert sorted((r.doc_id or 0, r.text or "") for r in one_of_each(df).collect()) == [
        (0, ""), (1, text), (2, "other"), (2, "words apart")]


def _folder():
    import tempfile
    return tempfile.mkdtemp(prefix="near-")
