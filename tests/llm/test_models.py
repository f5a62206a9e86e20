"""Language models, line field, Elias-Fano tries: brute force, exact round trips, held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldseq.llm import language, ngram_lm, quality_crf
from fieldseq.llm.elias_fano import Levels, Monotone, Trie, coded, log10_of
from fieldseq.llm.words import text_buffers

SYLLABLES = {"aa": ["ba", "no", "ti"], "bb": ["ke", "zu", "ño"], "cc": ["я", "шо", "ми"]}


def tongue(rng, name, n):
    return " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_language_of_held_out_and_odd_texts(spark):
    rng = random.Random(1)
    rows = [(i, tongue(rng, name := rng.choice(sorted(SYLLABLES)), 30), name) for i in range(240)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !! ", None), (903, rows[0][1], None), (903, rows[0][1], None),
           (904, tongue(rng, "cc", 9000), None), (905, "qqqq xxxx qqxx " * 40, None), (906, "Ba NO", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd],
                               "doc_id long, text string, lang string, lang_score int")
    model = language.fit(language.sample_texts(df.filter("doc_id < 160")))
    assert model.languages == sorted(SYLLABLES)
    out = language.identify(df, model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) + len(odd)
    assert all(got[i].lang_pred == name and not got[i].lang_rejected for i, _, name in rows if i >= 160)
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(got[i].lang_rejected for i in (900, 901, 902, 905))
    assert got[904].lang_pred == "cc" and got[906].lang_pred == "aa" and got[903].lang_pred == rows[0][2]
    assert language.identify(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    """Without labelled letters all texts are unknown, whatever they hold."""
    schema = "doc_id long, text string, lang string"
    for rows in ([], [(1, "12 !!", "aa"), (2, "ba no", None)], [(1, None, "aa")], [(1, "", "aa"), (2, "", "aa")]):
        df = spark.createDataFrame(rows, schema)
        model = language.fit(language.sample_texts(df))
        got = language.identify(df, model).collect()
        assert len(got) == len(rows) and all((r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True) for r in got)


def test_long_texts_and_repeated_rows_are_learned(spark):
    """A language that has only very long texts, or many rows of one id, is learned too."""
    rng = random.Random(3)
    rows = [(1, tongue(rng, "aa", 4000), "aa"), (2, tongue(rng, "aa", 6000), "aa")]
    rows += [(3, tongue(rng, "bb", 40), "bb")] * 300 + [(None, tongue(rng, "cc", 50), "cc")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.sample_texts(df, per_language=10, longest=1000)
    assert {k: len(v) for k, v in sample.items()} == {"aa": 10, "bb": 1, "cc": 1}
    assert all(len(t) <= 1000 for v in sample.values() for t in v)
    model = language.fit(sample)
    asked = [(i, tongue(rng, name, 20), name) for i, name in enumerate(["aa", "bb", "cc"] * 5)]
    got = language.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang for r in got)


def plain_kneser_ney(texts, order, alphabet):
    """Interpolated Kneser-Ney over letters of words, with dictionaries: p(symbol, history)."""
    grams = [Counter() for _ in range(order + 1)]
    for text in texts:
        for w in text.split():
            symbols = "^" + w + "$"
            for i in range(1, len(symbols)):
                for k in range(1, min(order, i + 1) + 1):
                    grams[k][symbols[i - k + 1:i + 1]] += 1
    used = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g in grams[k]:
            # as often as different symbols stand before it; whole counts at the order and at word starts
            used[k][g] = grams[k][g] if k == order or g[0] == "^" else sum(x[1:] == g for x in grams[k + 1])
    cut = [0.0] * (order + 1)
    for k in range(1, order + 1):
        n1, n2 = (sum(c == m for c in used[k].values()) for m in (1, 2))
        cut[k] = min(max((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1), 0.9)

    def p(symbol, history, k):
        if k == 0:
            return 1 / (alphabet + 1)
        history = history[len(history) - (k - 1):] if k > 1 else ""
        own = {g: c for g, c in used[k].items() if g[:-1] == history}
        lower = p(symbol, history, k - 1)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(history + symbol, 0) - cut[k], 0) / total + cut[k] * len(own) / total * lower
    return p


def test_letter_models_equal_plain_kneser_ney_and_sum_to_one():
    rng = random.Random(2)
    texts = {name: [tongue(rng, name, 40) for _ in range(4)] for name in ("aa", "bb")}
    model = language.fit(texts, order=3)
    seen = {c for t in texts.values() for x in t for c in x if c.isalpha()} | {"$"}
    for lang, name in enumerate(model.languages):
        p = plain_kneser_ney(texts[name], 3, len(seen))
        for history in ("^", "^b", "ba", "zz"):
            assert abs(sum(p(c, history, min(3, len(history) + 1)) for c in seen) + p(
                "?", history, min(3, len(history) + 1)) - 1) < 1e-9
        for word in ("bano", "zuke", "ño", "b", "tita", "яшо", "bqz"):
            symbols = "^" + word + "$"
            want = -sum(math.log2(p(symbols[i], symbols[:i], min(3, i + 1))) for i in range(1, len(symbols)))
            raw, offsets = text_buffers(pa.array([word]))
            got = model.word_costs(language.letter_words(raw, offsets))[0][lang]
            assert abs(got - want) < 1e-3, (name, word)


def brute_chain(u, steps):
    """Marginals of a binary chain by summing over all label sequences."""
    n = len(u)
    total, good = 0.0, np.zeros(n)
    for code in range(2 ** n):
        y = [(code >> i) & 1 for i in range(n)]
        w = math.exp(sum(a for a, b in zip(u, y) if b) + sum(steps[a][b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 7, 2]
    x = rng.normal(size=(sum(sizes), 3))
    doc = np.repeat([0, 2, 3, 5], sizes)
    f = quality_crf.Field(rng.normal(size=3), 0.3, rng.normal(size=(2, 2)), np.zeros(3), np.ones(3))
    p, pair = f.marginals(x, doc)
    u, at = x @ f.unary + f.bias, 0
    for n in sizes:
        assert np.allclose(p[at:at + n], brute_chain(u[at:at + n], f.steps))
        if n > 1:
            assert np.allclose(pair[at + 1:at + n].sum(axis=1)[:, 1], p[at + 1:at + n])
        at += n


def test_quality_on_held_out_documents_and_odd_texts(spark):
    rng = random.Random(3)

    def good():
        return "\n".join(" ".join("w%d" % rng.randrange(500) for _ in range(rng.randrange(4, 12))) + "."
                         for _ in range(rng.randrange(2, 7)))

    def bad():
        line = "BUY NOW!!! $$$ " * rng.randrange(2, 5)
        return good().split("\n")[0] + "\n" + "\n".join([line] * rng.randrange(3, 8))

    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(160)]
    odd = [(500, None), (501, ""), (502, "\n\n\n"), (503, "x " * 60_000), (504, rows[0][1]), (504, rows[0][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(100)] + [(7, 0, 0), (9, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    model = quality_crf.fit(df, labels, F.col("quality"))
    got = {r.doc_id: r.quality_score for r in quality_crf.score(df, model).collect()}
    right = [(got[i] >= 0.5) == (i % 4 != 0) for i in range(100, 160)]
    assert sum(right) >= 58 and all(0 <= v <= 1 for v in got.values())
    assert quality_crf.score(df.limit(0), model).count() == 0
    flat = quality_crf.fit(df, labels.filter("quality = 1"), F.col("quality"))
    assert all(0 <= r.quality_score <= 1 for r in quality_crf.score(df, flat).collect())


def test_monotone_round_trip():
    rng = np.random.default_rng(4)
    levels = Levels()
    cases = {"a": np.sort(rng.integers(0, 1 << 47, 1000)), "b": np.zeros(5, np.int64), "c": np.zeros(0, np.int64),
             "d": np.arange(300), "e": np.sort(rng.integers(0, 50, 4000)), "f": np.array([1 << 40])}
    for k, v in cases.items():
        levels.put_monotone(k, v)
        levels.put("x" + k, v.astype(np.uint16))
    for k, v in cases.items():
        code = levels.monotone(k)
        assert len(code) == len(v) and (code.at(np.arange(len(v))) == v).all()
        assert (levels.get("x" + k) == v.astype(np.uint16)).all()
        asked = np.concatenate((v, v + 1, np.maximum(v - 1, 0), rng.integers(0, 1 << 48, 500), [0, 1 << 60]))
        place, same = code.find(asked)
        assert (same == np.isin(asked, v)).all()
        assert not len(v) or (place == np.minimum(np.searchsorted(v, asked), len(v) - 1)).all()
    assert sum(levels.get(f"a.{x}").nbytes for x in ("low", "high", "ones")) < 1000 * 6
    levels.close()
    p = 10.0 ** -rng.uniform(0, 9, 500)
    assert np.abs(log10_of(coded(p)) - np.log10(p)).max() <= 0.5 / 2048 + 1e-12


def test_levels_are_searched_in_their_code(monkeypatch):
    """A lookup reads a few low bits of its bucket; no level is decoded whole."""
    read = []
    bits = Monotone._low_bits
    monkeypatch.setattr(Monotone, "_low_bits", lambda self, i: read.append(len(i)) or bits(self, i))
    rng = np.random.default_rng(8)
    v = np.unique(rng.integers(0, 1 << 40, 200_000))
    levels = Levels()
    levels.put_monotone("v", v)
    at, same = levels.monotone("v").find(v[::5000])
    assert same.all() and (at == np.arange(0, len(v), 5000)).all()
    assert sum(read) < 6 * len(at)
    levels.close()


def test_trie_equals_plain_model_and_sums_to_one():
    rng = random.Random(5)
    width, d = 9, 0.75
    grams = Counter((rng.randrange(6), rng.randrange(4), min(rng.randrange(9), rng.randrange(9))) for _ in range(300))
    rows = sorted((b, a, c, n) for (a, b, c), n in grams.items())
    w2, w1, w3, n = (np.array(x) for x in zip(*rows))
    low = np.array([rng.random() for _ in range(width)])
    low /= low.sum()
    trie = Trie(w1, w2, w3, n, low, width, d)

    def plain(a, b, c):
        kinds = {}
        for x, y, z in grams:
            if y == b:
                kinds.setdefault(z, set()).add(x)
        total = sum(map(len, kinds.values()))
        p = low[c]
        if total:
            p = max(len(kinds.get(c, ())) - d, 0) / total + d * len(kinds) / total * low[c]
        own = {z: m for (x, y, z), m in grams.items() if (x, y) == (a, b)}
        if own:
            p = max(own.get(c, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p
        return p

    asked = [(a, b, c) for a in range(8) for b in range(6) for c in range(width)]
    got = trie.log10(*(np.array(x) for x in zip(*asked)), np.log10(low))
    assert np.abs(got - np.log10([plain(*x) for x in asked])).max() < 0.002
    assert all(abs(sum(plain(a, b, c) for c in range(width)) - 1) < 1e-9 for a in range(8) for b in range(6))
    trie.close()
    none = Trie(*[np.zeros(0, np.int64)] * 4, low, width, d)
    assert np.allclose(none.log10(np.array([1]), np.array([2]), np.array([3]), np.log10(low)), np.log10(low[3]))
    none.close()


@pytest.mark.parametrize("context_tokens", [1_000_000, 40])
def test_scores_against_counting(spark, monkeypatch, context_tokens):
    """Base scores by counting; held-out copies score better; splitting contexts stays whole."""
    monkeypatch.setattr(ngram_lm, "CONTEXT_TOKENS", context_tokens)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "the", f"W{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 80)))
             for _ in range(60)]
    rows = [(i, t, i % 5 != 1) for i, t in enumerate(texts)]
    rows += [(100, texts[0], False), (101, texts[0], True), (102, None, True), (103, "", False),
             (104, "never seen words", False), (105, "the " * 20_000, False), (105, "the " * 20_000, False),
             (None, "the w1", True)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, train boolean, n_tokens int")
    import tempfile
    df.write.parquet(path := tempfile.mkdtemp(prefix="lm-") + "/d")
    got = ngram_lm.score_texts(spark.read.parquet(path)).collect()
    assert len(got) == len(rows)
    count = Counter(w for _, t, on in rows if on for w in [*(t or "").lower().split(), None])
    total = sum(count.values())
    norm = math.log10(total + 0.5 * (len(count) + 1))
    want = Counter()
    for i, t, _ in rows:
        w = [*(t or "").lower().split(), None]
        base = sum(math.log10(count[x] + 0.5) for x in w) - norm * len(w)
        want[i, len(w), sum(count[x] > 0 for x in w), round(base, 3)] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got)
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[100].score > by[100].base_score and abs(by[100].score - by[101].score) < 1e-3
    none = spark.read.parquet(path).selectExpr("doc_id", "text", "false as train")
    assert ngram_lm.score_texts(none).filter("score < 0 and train_tokens = 0").count() == len(rows)
    assert ngram_lm.score_texts(none.limit(0)).count() == 0


def stored_texts(spark, n=60):
    """Texts of few words, some of them held out; a seventh of the words occurs once or never in training."""
    import tempfile
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "the", "of", f"w{rng.randrange(40)}", f"r{rng.randrange(900)}"])
                         for _ in range(rng.randrange(1, 60))), i % 5 != 1) for i in range(n)]
    rows += [(500, "the unseen words of w1", False), (501, None, True), (502, "the of the of", False)]
    path = tempfile.mkdtemp(prefix="lm-") + "/d"
    spark.createDataFrame(rows, "doc_id long, text string, train boolean").write.parquet(path)
    return spark.read.parquet(path)


def plain_scores(rows):
    """log10 probabilities under an interpolated Kneser-Ney trigram model, counted with dictionaries."""
    d, count, triples = 0.75, Counter(), Counter()

    def events(text):
        w = ["<s>", "<s>", *(text or "").lower().split(), "</s>"]
        return list(zip(w, w[1:], w[2:]))

    for _, text, train in rows:
        if train:
            triples.update(events(text))
            count.update(z for _, _, z in events(text))
    n, v = sum(count.values()), len(count)
    after, follow = {}, {}
    for (x, y, z), m in triples.items():
        after.setdefault(y, Counter())[z] += 1
        follow.setdefault((x, y), {})[z] = m

    def level(seen, z, lower):
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen.get(z, 0) - d, 0) / total + d * len(seen) / total * lower

    def word(z):
        return (max(count[z] - d, 0) + d * v / (v + 1)) / n

    assert abs(sum(word(z) for z in count) + word("never seen") - 1) < 1e-9
    return {i: sum(math.log10(level(follow.get((x, y)), z, level(after.get(y), z, word(z))))
                   for x, y, z in events(text)) for i, text, _ in rows}


@pytest.mark.parametrize("context_tokens", [1_000_000, 40])
def test_scores_equal_a_plain_trigram_model(spark, monkeypatch, context_tokens):
    monkeypatch.setattr(ngram_lm, "CONTEXT_TOKENS", context_tokens)
    docs = stored_texts(spark, 120)
    want = plain_scores([tuple(r) for r in docs.select("doc_id", "text", "train").collect()])
    got = {r.doc_id: r for r in ngram_lm.score_texts(docs).collect()}
    assert set(got) == set(want)
    for i, score in want.items():
        assert abs(got[i].score - score) < 0.001 * got[i].n_tokens, (i, got[i].score, score)


def test_scores_do_not_depend_on_which_words_are_broadcast(spark):
    docs = stored_texts(spark)
    all_sent, none_sent = ({r.doc_id: r for r in ngram_lm.score_texts(docs, share).collect()} for share in (1e-6, 0.9))
    assert len(all_sent) == len(none_sent) == docs.count()
    for i, r in all_sent.items():
        assert none_sent[i].n_known == r.n_known and abs(none_sent[i].base_score - r.base_score) < 1e-3
        assert abs(none_sent[i].score - r.score) < 1e-3, i


def test_scores_do_not_depend_on_dealt_contexts(spark, monkeypatch):
    """Also not on the ids of texts, when the context before first words is dealt by them."""
    from pyspark.sql import functions as F
    docs = stored_texts(spark, 120)
    want = {r.doc_id: r for r in ngram_lm.score_texts(docs).collect()}
    monkeypatch.setattr(ngram_lm, "CONTEXT_TOKENS", 40)
    assert ngram_lm.count_unigrams(docs)[0].any_dealt() and docs.filter("train").count() > 40
    for add, share in ((0, 1e-6), (70_000, 0.9 / 40)):
        moved = docs.withColumn("doc_id", F.col("doc_id") + add)
        got = {r.doc_id - add: r for r in ngram_lm.score_texts(moved, share).collect()}
        assert len(got) == len(want)
        for i, r in want.items():
            assert abs(got[i].score - r.score) < 1e-3, (i, add)
            assert got[i].n_known == r.n_known and abs(got[i].base_score - r.base_score) < 1e-3
