"""Quadtrees and the source audit against plain counting, with odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldseq.llm import divergence, quadtree
from fieldseq.llm.divergence import audit


def matrix(seed, side, share):
    rng = np.random.default_rng(seed)
    m = rng.integers(1, 10 ** 12, (side, side)) * (rng.random((side, side)) < share)
    m[: side // 2, side // 2:] = 0
    return m


def grown(m, depth):
    r, c = np.nonzero(m)
    return quadtree.read(*quadtree.build(r, c, m[r, c], depth), depth)


@pytest.mark.parametrize("side,depth,share", [(32, 2, 0.05), (32, 2, 0.9), (30, 2, 0.0), (8, 0, 0.5), (64, 3, 0.01)])
def test_trees_give_back_their_cells(side, depth, share):
    m = matrix(1, side, share)
    rows, columns, counts = quadtree.leaf_cells(grown(m, depth))
    back = np.zeros_like(m)
    back[rows, columns] = counts
    assert (back == m).all() and len(rows) == (m > 0).sum()


def test_joint_walk_against_all_cells_and_prices_empty_quadrants_unseen():
    a, b = matrix(2, 64, 0.02), matrix(3, 64, 0.3)
    b[:, 40:] = 0
    n = [np.arange(64) + 10 ** 13, np.arange(64) * 7 + 10 ** 13]
    seen = []

    def price(totals, side):
        def of(rows, counts):
            seen.append(counts.size)
            return divergence.scaled(counts + 5, totals[np.minimum(rows, len(totals) - 1)])
        return of
    for columns, heights in ((64, (64, 64)), (51, (20, 64)), (0, (3, 2)), (9, (1, 17))):
        seen.clear()
        got = quadtree.differences(grown(a, 3), grown(b, 3), columns, heights, (price(n[0], 0), price(n[1], 1)))
        pa = divergence.scaled(a[:heights[0], :columns] + 5, n[0][:heights[0], None])
        pb = divergence.scaled(b[:heights[1], :columns] + 5, n[1][:heights[1], None])
        assert (got == np.abs(pa[:, None] - pb[None]).sum(axis=2)).all() and got.shape == heights
    sparse = np.zeros((64, 64), dtype=np.int64)
    sparse[3, 3] = 9
    seen.clear()
    quadtree.differences(grown(sparse, 3), grown(sparse, 3), 64, (64, 64), (price(n[0], 0), price(n[1], 1)))
    assert sum(seen) < 8 ** 3 * 2 * 64 / 20  # of all leaves of all pairs


def test_scaled_is_exact():
    for count, total in ((5, 7), (10 ** 17, 10 ** 17), (123456789, 9 * 10 ** 16), (1, 3), (5, 5)):
        assert divergence.scaled(np.array([count]), np.array([total]))[0] == 1 + 10 ** 9 * count // total


def expected(rows, least, added=5, top=50):
    groups, docs, words = set(), Counter(), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        docs.update({(lang, t) for t in terms})
        words[lang, source].update(terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (of, t), n in docs.items() if of == lang and n >= least]
        v = len(kept)
        whole = sum((words[g] for g in groups if g[0] == lang), Counter())

        def price(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + added) // (n + added * v) for t in kept}
        prices = {s: price(words[lang, s]) for of, s in groups if of == lang}
        q = price(whole)
        for s, p in prices.items():
            pairs = [(-sum(abs(p[t] - o[t]) for t in kept), b) for b, o in prices.items() if b != s]
            terms = [(q[t] - p[t], t) for t in kept if words[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in
                        enumerate(ordered if part == "pair" else ordered[:top])]
    return sorted(out)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["Über", "ÜBER", "ß", "don't", "x-y", "日本", "é"]
    rows = []
    for _ in range(n):
        source = rnd.choice(["s1", "s2", "s3", "S3", "ünder", None])
        liked = words[hash(source) % 5::2] if rnd.random() < 0.5 else words
        rows.append((rnd.choice(["en", "en", "de", None]), source, " ".join(rnd.choices(liked, k=rnd.randint(0, 30)))))
    rows += [("fr", "alone", "only few words"), ("fr", "other", None), ("it", "lone", "b"), ("en", "empty", ""),
             ("en", "numbers", "123 456 ..."), (None, None, None), ("en", "s1", "WA " * 3 + "\u0000wak\u0000" + "A" * 3000)]
    return rows


@pytest.mark.parametrize("tile,per_range,least", [(1024, 512, 4), (8, 5, 2), (3, 1000, 1), (16, 4, 10 ** 6)])
def test_audit_against_plain_counting(spark, tile, per_range, least):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, source string, text string, n int, item string")
    got = audit(df.repartition(4), least_docs=least, tile=tile, per_range=per_range)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, least)


def test_top_terms_and_more_groups_than_a_tile(spark):
    rows = [("en", f"s{i:02d}", " ".join(f"t{'abcdefghijklmnopqrstuvwxyz'[(i * 7 + j) % 26]}" for j in range(9))) for i in range(40)]
    got = audit(spark.createDataFrame(rows, "lang string, source string, text string"), 1, top=2, tile=8, per_range=6)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, 1, top=2)


def test_long_texts_go_in_pieces_and_dictionaries_are_bounded(spark):
    text = ("alpha beta-gamma " * 3000 + "x" * 5000 + " " + "日本 " * 500) * 2
    rows = [("en", "a", text), ("en", "b", "alpha zeta"), ("en", "b", "alpha beta")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    counts = {(r.source, bytes(r.term).decode()): (r.n, r.docs) for r in divergence.term_counts(df, 2, 100).collect()}
    assert counts == {("a", "alpha"): (6000, 1), ("a", "beta"): (6000, 1), ("a", "gamma"): (6000, 1), ("a", "x" * 5000): (2, 1),
                      ("a", "日本"): (1000, 1), ("b", "alpha"): (2, 2), ("b", "zeta"): (1, 1), ("b", "beta"): (1, 1)}


def test_no_rows(spark):
    assert audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
