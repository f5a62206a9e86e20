"""Filters, TF-IDF, vectors, fusion and shapes against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldseq.operators import dense, filters, fuse, sparse
from fieldseq.operators.filters import FILTER_TYPE, Filters

POSS = ("uid string, team string, opponent string, competition string, season string, "
        "play_pattern string, start_zone string, end_zone string, ended_in_shot boolean, "
        "ended_in_goal boolean, xg_sum double, n_events int, token_string string, zone_path string")


def possession_rows(n=80, seed=1):
    rnd = random.Random(seed)
    zones = ["D-C", "M-C", "F-C", "F-L", "M-R"]
    rows = []
    for i in range(n):
        zs = [rnd.choice(zones) for _ in range(rnd.randint(3, 9))]
        toks = [f"{rnd.choice(['PASS', 'CARRY', 'SHOT', 'RECV'])}@{z}" for z in zs]
        rows.append((f"1:{i}", rnd.choice("AB"), "X", "C1", "S1",
                     rnd.choice(["Regular Play", "From Corner", None]), zs[0], zs[-1],
                     rnd.random() < .5, rnd.random() < .2, rnd.choice([0.0, 0.3, 0.5]), len(zs),
                     " ".join(toks), " ".join(zs)))
    return rows


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(possession_rows(), POSS)


WANTED = {"a": Filters(), "b": Filters(team="A", end_band="F"),
          "c": Filters(ended_in_shot=False, min_xg=0.3), "d": Filters(must_include=("SHOT", "M-C")),
          "e": Filters(play_pattern="From Corner", min_events=5, start_zone="D-C"),
          "f": Filters(must_include=("100%",)), "g": Filters(ended_in_goal=True, start_band="M")}


def test_both_filter_forms_agree(spark, items):
    table = spark.createDataFrame([(q, f.as_row()) for q, f in WANTED.items()],
                                  spark.createDataFrame([], "qid string").schema.add(
                                      "filters", FILTER_TYPE))
    pairs = filters.candidate_pairs(items, table)
    left = {tuple(r) for r in pairs.collect()}
    assert len(left) == pairs.count()
    right = {tuple(r) for r in filters.candidates(items, WANTED).select("qid", "uid").collect()}
    assert left == right and len({q for q, _ in left}) >= 5
    counts = {r.qid: r.n_candidates for r in filters.candidate_counts(items, WANTED).collect()}
    assert counts == {q: sum(1 for a, _ in right if a == q) for q in WANTED}
    assert counts["f"] == 0 and counts["a"] == 80
    assert {r.qid: r.n_candidates for r in filters.counted(pairs, table).collect()} == counts


def test_given_and_merge(spark):
    assert Filters(ended_in_shot=False, min_events=0).given() == ("ended_in_shot", "min_events")
    assert Filters().is_empty() and not Filters(min_xg=0.0).is_empty()
    parsed = Filters(team="A", ended_in_shot=True)
    assert parsed.overridden_by(Filters(ended_in_shot=False)) == Filters("A", ended_in_shot=False)
    schema = spark.createDataFrame([], "q string").schema.add("p", FILTER_TYPE).add("e", FILTER_TYPE)
    df = spark.createDataFrame([("1", parsed.as_row(), Filters(ended_in_shot=False).as_row())], schema)
    row = df.select(filters.merged(F.col("p"), F.col("e")).alias("m")).first().m
    assert (row.team, row.ended_in_shot) == ("A", False)
    got = df.select(filters.given_fields(F.col("p"))).first()[0]
    assert sorted(got) == ["ended_in_shot", "team"]


def grams(words):
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_tfidf(docs):
    counts = {d: Counter(grams(t.split())) for d, t in docs.items()}
    df = Counter(g for c in counts.values() for g in c)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def vector(c):
        raw = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {g: v / norm for g, v in raw.items()} if raw else {}
    return {d: vector(c) for d, c in counts.items()}, lambda t: vector(Counter(grams(t.split())))


def test_sparse_scores_both_joins(spark, items, monkeypatch):
    docs = {r[0]: r[12] for r in possession_rows()}
    vectors, query_vector = plain_tfidf(docs)
    queries = {"q1": "PASS@D-C CARRY@M-C SHOT@F-C", "q2": "RECV@F-L", "q3": "nothing known"}
    monkeypatch.setattr(sparse, "ROWS_PER_SALT", 5)
    index = sparse.fit_index(items, "uid", F.split("token_string", " "))
    table = spark.createDataFrame(list(queries.items()), "qid string, text string")
    asked = sparse.query_vectors(table, index.vocab, F.split("text", " "))
    assert index.vocab.agg(F.max("salts")).first()[0] > 1
    want = {}
    for q, t in queries.items():
        v = query_vector(t)
        for d, w in vectors.items():
            s = sum(v[g] * w[g] for g in v if g in w)
            if s > 0:
                want[q, d] = s
    for small in (True, False, None):
        got = {(r.qid, r.uid): r.score for r in sparse.scores(asked, index, small=small).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    ranked = sparse.rank(sparse.scores(asked, index), "uid", 5).collect()
    order = sorted((k for k in want if k[0] == "q1"), key=lambda k: (-round(want[k], 9), k[1]))[:5]
    assert [r.uid for r in sorted(ranked, key=lambda r: r["rank"]) if r.qid == "q1"] == \
        [k[1] for k in order]


def test_saved_index_gives_the_same(spark, items, tmp_path):
    index = sparse.fit_index(items, "uid", F.split("token_string", " "))
    index.save(str(tmp_path))
    again = sparse.SparseIndex.load(spark, str(tmp_path), "uid")
    a = {(r.uid, r.gram): round(r.weight, 9) for r in index.postings.collect()}
    assert a == {(r.uid, r.gram): round(r.weight, 9) for r in again.postings.collect()}


def test_hot_gram_lookup_is_whole(spark, monkeypatch):
    """A word in every document and words in few give the same index either way."""
    docs = spark.createDataFrame([(i, f"the w{i % 7} x{i % 3}") for i in range(60)],
                                 "id int, text string")
    def weights(limit):
        monkeypatch.setattr(sparse, "HOT_LIMIT", limit)
        index = sparse.fit_index(docs, "id", F.split("text", " "))
        return {(r.id, r.gram): round(r.weight, 9) for r in index.postings.collect()}
    assert weights(0) == weights(5) == weights(10 ** 9)


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, None)]
    return rows, spark.createDataFrame(rows, "uid int, embedding array<float>")


def test_nearest_scan_blocks_and_brute_force(spark, vectors, monkeypatch):
    rows, items = vectors
    known = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v]
    asked = items.filter("uid < 15").select(F.col("uid").alias("qid"), "embedding",
                                            F.col("uid").alias("seed"))
    marked = items.withColumn("may", F.when(F.col("uid") % 2 == 0, F.array(
        *[F.lit(i) for i in range(15)])).otherwise(F.array(F.lit(3))))

    def brute(k, exclude, allowed):
        out = []
        for q, a in known[:15]:
            sims = [(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), i)
                    for i, b in known if not (exclude and i == q)
                    and (not allowed or i % 2 == 0 or q == 3)]
            out += [(q, i, r) for r, (_, i) in enumerate(sorted(sims)[:k])]
        return sorted(out)

    for exclude, allowed in ((None, None), ("seed", None), ("seed", "may")):
        want = brute(7, exclude, allowed)
        for cells in (10 ** 6, 1):
            monkeypatch.setattr(dense, "BLOCK_ROWS", 9)
            monkeypatch.setattr(dense, "TILE", 4)
            got = dense.nearest(asked, marked, 7, exclude=exclude, allowed=allowed,
                                matrix_cells=cells)
            assert sorted((r.qid, r.uid, r["rank"]) for r in got.collect()) == want


def test_token_vectors_have_unit_length(items):
    got = dense.token_vectors(items, size=8).collect()
    assert len(got) == 80
    assert all(abs(sum(v * v for v in r.embedding) - 1) < 1e-6 for r in got)


def test_fusion(spark):
    def ranking(ids):
        return spark.createDataFrame([("q", u, i) for i, u in enumerate(ids)],
                                     "qid string, uid string, rank int")
    fused = fuse.fuse([ranking(["a", "b", "c"]), ranking(["c", "d"])]).orderBy("rank").collect()
    scores = {"a": 1 / 61, "b": 1 / 62, "c": 1 / 63 + 1 / 61, "d": 1 / 62}
    assert [r.uid for r in fused] == sorted(scores, key=lambda u: (-scores[u], u))
    alone = fuse.fuse([ranking(["z", "y", "x"])]).orderBy("rank").collect()
    assert [r.uid for r in alone] == ["z", "y", "x"]


def test_similar_never_returns_the_seed(spark, items):
    index = sparse.fit_index(items, "uid", F.split("token_string", " "))
    seeds = spark.createDataFrame([("s", "1:3"), ("t", "no such")], "qid string, uid string")
    got = fuse.similar(seeds, index)["fused"].collect()
    assert got and {r.qid for r in got} == {"s"} and "1:3" not in {r.uid for r in got}
    assert [r.uid for r in fuse.unknown_seeds(seeds, index).collect()] == ["no such"]


def filter_table(spark, wanted, extra="", values=lambda q: ()):
    schema = spark.createDataFrame([], "qid string").schema.add("filters", FILTER_TYPE)
    for f in spark.createDataFrame([], extra).schema if extra else []:
        schema = schema.add(f)
    return spark.createDataFrame([(q, f.as_row(), *values(q)) for q, f in wanted.items()], schema)


def test_no_returned_row_breaks_a_filter(spark, items):
    """Sparse, dense, fused and similar rankings hold nothing but candidates."""
    words = F.split("token_string", " ")
    index = sparse.fit_index(items, "uid", words)
    vectors = items.select("uid", dense.zone_profile(F.col("zone_path")).alias("embedding"))
    vectors = vectors.unionByName(spark.createDataFrame([("none", [0.0] * 15)], vectors.schema))
    may = {(r.qid, r.uid) for r in filters.candidates(items, WANTED).collect()}
    hint = " ".join(r.token_string for r in items.limit(5).collect())
    asked = filter_table(spark, WANTED, "hint string, embedding array<double>",
                         lambda q: (hint, [1.0] * 15))
    found = fuse.hybrid(asked, items, index, F.split("hint", " "), vectors, limit=100, pool=100)
    for name in ("sparse", "dense", "fused"):
        got = {(r.qid, r.uid) for r in found[name].collect()}
        assert got <= may and {q for q, _ in got} == {q for q, _ in may}, name
    assert {(r.qid, r.uid) for r in found["dense"].collect()} == may
    with pytest.raises(ValueError):
        fuse.hybrid(asked.drop("filters"), items, index, F.split("hint", " "))
    seeds = filter_table(spark, WANTED, "uid string", lambda q: ("1:3",))
    near = fuse.similar(seeds, index, vectors, 100, 100, items)
    for name in ("sparse", "dense", "fused"):
        got = {(r.qid, r.uid) for r in near[name].collect()}
        assert got and got <= may and "1:3" not in {u for _, u in got}, name


@pytest.mark.parametrize("cells", [10 ** 6, 1])
def test_zero_vectors_cost_no_places(spark, cells):
    """Vectors without a direction take no part, and the others all stay."""
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [0.9, 0.1]), ("d", [0.0, 1.0]), ("e", [nan, 1.0]),
            ("f", None), ("g", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "uid string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("r", [0.0, 2.0])],
                                  "qid string, embedding array<double>")
    got = {}
    for r in dense.nearest(asked, df, 2, matrix_cells=cells).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.uid)
    assert got == {"q": ["a", "c"], "r": ["d", "c"]}


def test_names_without_letters_and_long_names(spark):
    from fieldseq.operators import annotate
    texts = spark.createDataFrame([(1, "we saw *** there"), (2, "one two three four five"), (3, "a***b"),
                                   (4, "... and *** ..."), (5, None), (6, "one two three fourty")],
                                  "id long, text string")
    names = spark.createDataFrame([("***",), ("...",), ("One Two",), ("one two three four",), ("",)], "name string")
    got = {r.id: (r.name, r.pos) for r in annotate.longest_entity(texts, names).collect()}
    assert got == {1: ("***", 7), 2: ("one two three four", 0), 4: ("***", 8), 6: ("One Two", 0)}


SHAPE_CASES = [(["D-C", "M-C", "F-C"], "D-C D-C M-C M-C M-C F-C", 1.0),
               (["D-C", "F-C"], "D-C M-C F-C", 0.667), (["F-C", "D-C"], "D-C M-C F-C", None),
               (["D-C"], "D-C M-C D-C F-C", 0.25), (["D-C", "D-C", "F-C"], "D-C F-C", 1.0)]


@pytest.mark.parametrize("shape,path,score", SHAPE_CASES)
def test_shapes(spark, shape, path, score):
    row = list(possession_rows(1)[0])
    row[13] = path
    got = fuse.shape_search(spark.createDataFrame([tuple(row)], POSS), {"s": shape}).collect()
    assert [r.score for r in got] == ([score] if score is not None else [])


def test_shape_order(spark):
    base = list(possession_rows(1)[0])
    rows = []
    for uid, path, n in (("a", "D-C F-C", 5), ("b", "D-C F-C", 9), ("c", "D-C F-C", 9),
                         ("d", "D-C M-C F-C", 99)):
        rows.append((uid, *base[1:11], n, base[12], path))
    got = fuse.shape_search(spark.createDataFrame(rows, POSS), {"s": ["D-C", "F-C"]})
    assert [r.uid for r in got.orderBy("rank").collect()] == ["c", "b", "a", "d"]


def test_unknown_zones(spark):
    df = spark.createDataFrame([(["D-C", "Q-Z"],)], "z array<string>")
    assert df.select(filters.unknown_zones(F.col("z"), ("D-C",))).first()[0] == ["Q-Z"]
