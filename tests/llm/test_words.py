import random

import numpy as np
import pyarrow as pa
import pytest

from fieldseq.llm import words as W

TEXTS = ["Ab cd\tEF", None, "", "   ", "one", "é ü x  \u0085y", "a b c d e f a b c d e f",
         "x " * 50, "Ab cd\tEF", "\x1c\x1d in one", "日本 語"]


def plain(text):
    return (text or "").encode().lower().split(None) if text and not set("\x1c\x1d\x1e\x1f") & set(text) \
        else [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]


@pytest.mark.parametrize("limit", [4 << 20, 16])
def test_words_like_split(monkeypatch, limit):
    monkeypatch.setattr(W, "SLICE_BYTES", limit)
    h, doc = W.words(pa.array(TEXTS))
    want = [(d, w) for d, t in enumerate(TEXTS) for w in plain(t)]
    assert doc.tolist() == [d for d, _ in want]
    by_word = {}
    for (_, w), x in zip(want, h.tolist()):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_a_slice_of_an_array_and_large_strings():
    h, _ = W.words(pa.array(TEXTS))
    a, doc = W.words(pa.array(TEXTS).slice(4, 4))
    b, _ = W.words(pa.array(TEXTS, pa.large_string()).slice(4, 4))
    assert (a == b).all() and set(a.tolist()) <= set(h.tolist()) and doc.min() == 0


def test_shingles_are_distinct_word_windows():
    random.seed(1)
    texts = [" ".join(random.choice("abc") for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 40, 300)]
    h, doc = W.words(pa.array(texts))
    d, s = W.shingles(h, doc, len(texts))
    for i, t in enumerate(texts):
        w = t.split()
        want = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
        assert (d == i).sum() == len(want)
        assert len(np.unique(s[d == i])) == len(want)
    assert len(W.shingles(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3)[0]) == 0
