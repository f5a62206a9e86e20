"""Predicate index and phrase automaton against plain tests of every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_retrieval import POSS, WANTED, filter_table, possession_rows

from fieldseq.operators import automaton, dense, filters, fuse, predicate_index, sparse
from fieldseq.operators.filters import Filters


def many_filters(n, seed=5):
    rnd = random.Random(seed)
    out = {}
    for i in range(n):
        kinds = rnd.sample(range(10), rnd.choice([0, 1, 1, 2, 3]))
        given = {}
        for kind in kinds:
            given |= [{"team": rnd.choice("ABC")}, {"play_pattern": "From Corner"}, {"start_band": rnd.choice("DMF")},
                      {"end_band": rnd.choice(["D", "F", "F-C"])}, {"ended_in_shot": rnd.random() < 0.5},
                      {"min_xg": rnd.choice([0.0, 0.3, 0.4, 9.0])}, {"min_events": rnd.choice([3, 5, 8])},
                      {"must_include": tuple(rnd.sample(["SHOT", "PASS@M", "@F-L", "", "none", "CARRY@D-C PASS"], 2))},
                      {"start_zone": "M-C"}, {"ended_in_goal": True, "season": "S1"}][kind]
        out[f"q{i}"] = Filters(**given)
    return out


@pytest.fixture(scope="module")
def items(spark):
    rows = [list(r) for r in possession_rows(60, 3)]
    rows[0][4] = rows[1][1] = rows[2][6] = rows[3][12] = rows[4][8] = rows[5][10] = rows[6][11] = None
    rows[7][10], rows[8][6], rows[9][7] = float("nan"), "A-B-C", "nohyphen"
    return spark.createDataFrame([tuple(r) for r in rows], POSS).repartition(3)


def test_a_thousand_queries_against_every_pair(spark, items):
    wanted = {**many_filters(1000), **WANTED, "deep": Filters(start_band="A-B"), "only": Filters(start_band="nohyphen")}
    want = {(r.qid, r.uid) for r in filters.candidates(items, wanted).select("qid", "uid").collect()}
    table = filter_table(spark, wanted).unionByName(
        spark.createDataFrame([("nothing", None)], filter_table(spark, WANTED).schema))
    want |= {("nothing", r.uid) for r in items.collect()}
    index = predicate_index.build(table)
    held = index.probe(items)
    assert held.count() == 60 and index.predicates.count() < 30 < index.needs.count()
    met = {(r.qid, r.uid) for r in predicate_index.candidates(index.needs, held).collect()}
    bare = {q for q, f in wanted.items() if set(f.given()) <= {"min_xg", "min_events"}} | {"nothing"}
    assert met == {p for p in want if p[0] not in bare}
    for steps in (10_000, 2):
        counts = {r.qid: r.n_candidates for r in predicate_index.counts(index.needs, held, steps=steps).collect()}
        assert counts == {q: sum(a == q for a, _ in want) for q in [*wanted, "nothing"]}
    rows, asked = held.toPandas(), index.needs.toPandas()
    matrix = predicate_index.may(rows, asked)
    assert {(asked.qid[j], rows.uid[i]) for i, j in zip(*np.nonzero(matrix))} == want


def test_rankings_of_many_queries_hold_candidates_only(spark, items):
    wanted = many_filters(1000, 8)
    may = {(r.qid, r.uid) for r in filters.candidates(items, wanted).select("qid", "uid").collect()}
    words = F.split("token_string", " ")
    index = sparse.fit_index(items.filter("token_string is not null"), "uid", words)
    vectors = items.select("uid", dense.zone_profile(F.col("zone_path")).alias("embedding"))
    hint = " ".join(r.token_string for r in items.filter("token_string is not null").limit(9).collect())
    asked = filter_table(spark, wanted, "hint string, embedding array<double>", lambda q: (hint, [1.0] * 15))
    found = fuse.hybrid(asked, items, index, F.split("hint", " "), vectors, limit=60, pool=60)
    assert {(r.qid, r.uid) for r in found["dense"].collect()} == may
    sparse_pairs = {(r.qid, r.uid) for r in found["sparse"].collect()}
    assert sparse_pairs <= may and len(sparse_pairs) > len(may) * 0.9


def test_tables_without_filters_or_items(spark, items):
    empty = filter_table(spark, {"a": Filters()})
    index = predicate_index.build(empty)
    assert index.predicates.count() == 0
    assert [tuple(r) for r in predicate_index.counts(index.needs, index.probe(items)).collect()] == [("a", 60)]
    none = index.probe(items.filter("uid = 'x'"))
    assert [tuple(r) for r in predicate_index.counts(index.needs, none).collect()] == [("a", 0)]
    assert predicate_index.counts(index.needs.filter("qid = 'x'"), none).count() == 0


def test_automaton_finds_all_places(spark):
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choices("ab é1", k=rnd.randint(0, 60)))) for i in range(40)] + [(99, None), (98, "")]
    phrases = [(i, "".join(rnd.choices("ab é1", k=rnd.randint(1, 3)))) for i in range(25)] + [(100, ""), (101, None), (102, "zz")]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "number long, phrase string")

    def whole(text, at, phrase):
        return not ((at and text[at - 1].isalnum()) or text[at + len(phrase):at + len(phrase) + 1].isalnum())
    for words, once, most in ((False, False, 50), (True, False, 6), (True, True, 50), (False, True, 4)):
        want = set()
        for i, text in texts:
            for n, phrase in phrases:
                if text is None or phrase is None:
                    continue
                places = [at for at in range(len(text)) if text.startswith(phrase, at)] if phrase else [0]
                if words and phrase:
                    places = [at for at in places if whole(text, at, phrase)]
                want |= {(i, n, at) for at in (places[:1] if once else places)}
        got = automaton.occurrences(t, p, words=words, once=once, most=most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert automaton.occurrences(t, p.filter("number < 0")).count() == 0
    first = {}
    for i, text in texts:
        for n, phrase in phrases:
            at = text.find(phrase) if text is not None and phrase else -1
            if at >= 0 and whole(text, at, phrase):
                first.setdefault(i, []).append((n, at))
    got = automaton.occurrences(t, p.filter("phrase <> ''"), words=True, once=True, leading=True, lowest=True).collect()
    assert {r.id: (r.number, r.pos) for r in got} == {i: min(hits) for i, hits in first.items()}


def test_shape_tables_against_the_literal_form(spark, items):
    from fieldseq.operators import shapes
    from fieldseq.spec import ZONES
    rnd = random.Random(6)
    rows = [tuple(r) for r in items.collect()]
    rows += [("odd", *rows[0][1:13], "Q-Z D-C Q-Z F-C"), ("one", *rows[0][1:13], "F-C"), ("null", *rows[0][1:13], None)]
    paths = spark.createDataFrame(rows, POSS)
    drawn = {f"s{i}": [rnd.choice(["D-C", "M-C", "F-C", "F-L", "M-R"]) for _ in range(rnd.randint(1, 4))] for i in range(120)}
    drawn |= {"loop": ["M-C", "F-C", "M-C"], "never": ["D-RI", "D-C"], "same": ["D-C", "D-C"]}
    wanted = {q: f for q, f in zip(drawn, many_filters(60).values())}
    schema = spark.createDataFrame([], "qid string, zones array<string>").schema.add("filters", filters.FILTER_TYPE)
    table = spark.createDataFrame([(q, z, wanted.get(q, Filters()).as_row()) for q, z in drawn.items()]
                                  + [("bad", ["Q-Z"], None), ("none", [], None), ("null", None, None)], schema)
    for t, w in ((table.drop("filters"), {}), (table, wanted)):
        got = {(r.qid, r.uid, r.n_events, r.coverage) for r in shapes.matches(paths, t).collect()}
        want = {(r.qid, r.uid, r.n_events, r.coverage) for r in
                fuse.shape_matches(paths.filter("zone_path is not null"), drawn, w).collect()}
        assert got == want and len({q for q, *_ in got}) > 60
    assert {r.qid for r in shapes.unknown_shapes(table).collect()} == {"bad", "none", "null"}
    assert shapes.matches(paths, table.filter("qid = 'bad'")).count() == 0
    words = paths.filter("uid = 'one'").select(shapes.signature(F.split("zone_path", " "))).first()[0]
    assert words[ZONES.index("F-C")] == 1 << len(ZONES) and sum(words) == 1 << len(ZONES)
