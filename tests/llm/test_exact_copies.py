"""Counting quotient filters and exact copies, with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldseq.llm import exact_dedup, quotient_filter
from fieldseq.llm.exact_dedup import exact_copies, fingerprint_counts, merged_filters


def arrays(counted):
    prints = np.array(sorted(counted), dtype=np.int64)
    return prints, np.array([counted[p] for p in prints.tolist()], dtype=np.int64)


def as_counter(data):
    prints, counts = quotient_filter.entries(data)
    assert (np.diff(prints) > 0).all()
    return Counter(dict(zip(prints.tolist(), counts.tolist())))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 2 ** 12 - 1), st.integers(1, 10 ** 6), max_size=300))
def test_a_filter_gives_back_what_it_counted(counted):
    assert as_counter(quotient_filter.build(*arrays(counted), 12)) == Counter(counted)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2 ** 9 - 1), st.integers(1, 40), max_size=60), max_size=6))
def test_merging_adds_counts(parts):
    merged = quotient_filter.merge((quotient_filter.build(*arrays(p), 9) for p in parts), 9)
    assert as_counter(merged) == sum(map(Counter, parts), Counter())


@pytest.mark.parametrize("bits", [2, 5, 30, 56, 63])
def test_filters_of_many_widths(bits):
    rnd = random.Random(bits)
    counted = {rnd.randrange(1 << bits): rnd.choice([1, 1, 2, 3, 2 ** 40]) for _ in range(2000)}
    counted |= {(1 << bits) - 1: 7, 0: 1}
    data = quotient_filter.build(*arrays(counted), bits)
    assert as_counter(data) == Counter(counted)
    if bits == 56:
        assert len(data) < 2000 * 14  # of 16 as plain numbers; three in five need slots for counts


def test_counts_over_partitions(spark):
    rnd = random.Random(4)
    prints = [rnd.randrange(1 << 20) for _ in range(3000)] + [77] * 1500
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(7)
    for per_range, held in ((1 << 20, 1 << 20), (64, 100)):
        merged = merged_filters(df, len(prints), 20, per_range, held)
        assert {r.fp: r.n for r in fingerprint_counts(merged).collect()} == Counter(prints)
        assert {r.fp for r in fingerprint_counts(merged, 2).collect()} == {p for p, n in Counter(prints).items() if n > 1}


TEXTS = ["a b", "a  b", "a\tb", "a \r\n b", " a b", "a b ", "a b", "A b", "", None, " ", "\n\t", "a\x0bb", "é", "é"]


def expected(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups, out, stays = {}, [], set()
    for (i, _), t in zip(rows, texts):
        groups.setdefault(t, []).append(i)
    for (i, _), t in zip(rows, texts):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and t not in stays
        if kept:
            stays.add(t)
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,routes", [(56, 1 << 20), (4, 1 << 20), (4, 4), (20, 2), (1, 1)])
def test_copies_also_when_fingerprints_collide(spark, bits, routes):
    rnd = random.Random(1)
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(i, " ".join(rnd.choices("xyz", k=rnd.randint(0, 3)))) for i in range(90)]
    rows += [(300 + i, "hot  text") for i in range(60)] + [(1000, "long " * 300_000), (1001, "long\n" * 300_000)]
    rows += [(None, "x y"), (None, "only null"), (None, "only null"), (7, "again"), (7, "again"), (8, "again"), (9, "z"), (9, "q")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, keep string, size int")
    got = exact_copies(df.repartition(6), bits=bits, per_range=32, routes=routes).collect()
    assert sorted([tuple(r) for r in got], key=repr) == expected(rows)


def test_hot_groups_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_PARTS", 3)
    rows = [(i, "same" if i % 2 else f"t{i}") for i in range(80)]
    got = exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=repr) == expected(rows)


def test_no_rows(spark):
    assert exact_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
