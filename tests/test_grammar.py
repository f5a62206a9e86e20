"""Zones, actions, modifiers, tokens and sequence expressions."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldseq.functions import geometry as X
from fieldseq.functions import grammar as G

EVENT = ("type string, pass_type string, is_cross boolean, technique string, x double, y double, "
         "end_x double, end_y double, pressed boolean")


def tokens(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + EVENT)
    c = F.col
    word = G.action(c("type"), c("pass_type"), c("is_cross"), c("technique"), c("x"), c("y"),
                    c("end_x"), c("end_y"))
    df = df.withColumn("w", word)
    out = df.select("i", G.token(c("w"), c("x"), c("y"), c("end_x"), c("end_y"), c("pressed")))
    return [r[1] for r in sorted(out.collect())]


def test_rule_order_and_modifiers(spark):
    got = tokens(spark, [
        ("Pass", "Corner", True, None, 120.0, 80.0, 110.0, 40.0, False),
        ("Pass", None, True, "Through Ball", 100.0, 70.0, 110.0, 40.0, True),
        ("Pass", None, False, "Through Ball", 60.0, 40.0, 61.0, 41.0, None),
        ("Pass", None, False, None, 50.0, 5.0, 55.0, 70.0, False),
        ("Pass", None, False, None, 50.0, 5.0, 45.0, 10.0, False),
        ("Pass", None, False, None, 50.0, 5.0, None, None, False),
        ("Pass", None, False, None, 81.0, 5.0, 79.0, 5.0, False),
        ("Pass", None, False, None, 79.0, 5.0, 81.0, 5.0, False),
        ("Shot", None, False, None, 100.0, 40.0, 120.0, 40.0, True),
        ("Pressure", None, False, None, 50.0, 5.0, None, None, False),
        ("Something new", None, False, None, 50.0, 5.0, None, None, False),
        ("Carry", None, False, None, None, None, None, None, False),
        ("Miscontrol", None, False, None, -3.0, 90.0, None, None, False),
        ("Dispossessed", None, False, None, 120.0, 80.0, None, None, False)])
    assert got == ["SETP@F-R>", "CROSS@F-R>^", "THROUGH@M-C", "SWITCH@M-L", "PASS@M-L",
                   "PASS@M-L", "PASS@F-L", "PASS@M-L+", "SHOT@F-C^", None, None, None,
                   "LOSS@D-R", "LOSS@F-R"]


def test_zone_borders(spark):
    df = spark.createDataFrame([(0.0, 0.0), (39.999, 15.999), (40.0, 16.0), (80.0, 32.0),
                                (120.0, 64.0), (-5.0, 200.0)], "x double, y double")
    got = [r[0] for r in df.select(G.zone(F.col("x"), F.col("y"))).collect()]
    assert got == ["D-L", "D-L", "M-LI", "F-C", "F-R", "D-R"]


def test_lexeme_and_token_parts(spark):
    df = spark.createDataFrame([("CROSS@F-R>^",), ("PASS@M-LI+",), ("odd",)], "t string")
    got = [tuple(r) for r in df.select(
        G.lexeme(F.col("t")), G.zone_of(F.col("t")), G.band_of(F.col("t")),
        G.side_of(G.zone_of(F.col("t")))).collect()]
    assert got[0] == ("cross_f_r_box_prs", "F-R", "F", "R")
    assert got[1] == ("pass_m_li_prg", "M-LI", "M", "L")
    assert got[2][1] == ""


def test_token_helpers(spark):
    df = spark.createDataFrame([("PASS@M-C SHOT@F-C PASS@F-C SHOT@F-LI",), ("PASS@M-C",)],
                               "ts string")
    t = G.tokens_of(F.col("ts"))
    got = [tuple(r) for r in df.select(
        G.any_token(t, "CROSS", "SHOT"), G.first_index(t, "SHOT", "CROSS"), G.shot_indices(t),
        G.last_shot_zone(F.col("ts"))).collect()]
    assert got == [(True, 1, [1, 3], "F-LI"), (False, None, [], "")]


def test_uid_round_trip(spark):
    df = spark.createDataFrame([(12, 7)], "m bigint, p bigint")
    uid = G.possession_uid(F.col("m"), F.col("p"))
    row = df.select(uid.alias("u"), *G.split_uid(uid)).first()
    assert tuple(row) == ("12:7", 12, 7)


def plain_ngrams(w):
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), min_size=1, max_size=30))
def test_sequences_against_plain_python(spark, lists):
    rows = [(i, x, x[:2][::-1]) for i, x in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, p array<string>, s array<string>")
    out = df.select("i", G.collapse_repeats(F.col("p")), G.is_subsequence(F.col("s"), F.col("p")),
                    G.ngrams(F.col("p")))
    for i, collapsed, found, grams in out.collect():
        p, s = lists[i], rows[i][2]
        assert collapsed == [z for j, z in enumerate(p) if j == 0 or p[j - 1] != z]
        it = iter(p)
        assert found == all(z in it for z in s)
        assert sorted(grams) == sorted(plain_ngrams(p))


def test_geometry(spark):
    df = spark.createDataFrame([(114.0, 40.0), (120.0, 36.0), (120.0, 10.0)], "x double, y double")
    got = [tuple(r) for r in df.select(X.distance_to_goal(F.col("x"), F.col("y")),
                                       X.goal_angle(F.col("x"), F.col("y"))).collect()]
    assert got[0][0] == pytest.approx(6.0)
    assert got[0][1] == pytest.approx(2 * math.atan2(4, 6))
    assert got[1][1] == 0.0 and got[2][1] == pytest.approx(0.0)


def plain_frame(frame, x, y):
    if not frame:
        return (None,) * 4
    def turn(ax, ay, bx, by):
        return (px - bx) * (ay - by) - (ax - bx) * (py - by)
    inside, near, keeper = 0, None, None
    for loc, name, mate in frame:
        if mate is None or mate or len(loc) < 2:
            continue
        px, py = loc
        if name == "Goalkeeper":
            keeper = loc
            continue
        t = (turn(x, y, 120, 36), turn(120, 36, 120, 44), turn(120, 44, x, y))
        inside += not (min(t) < 0 < max(t))
        d = math.hypot(px - x, py - y)
        near = d if near is None else min(near, d)
    return (inside, near, keeper and math.hypot(120 - keeper[0], 40 - keeper[1]),
            keeper and 120 - keeper[0])


def test_freeze_frames(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        frame = None if i % 7 == 0 else [] if i % 11 == 0 else [
            ([rnd.uniform(80, 120), rnd.uniform(0, 80)][:rnd.choice([2, 2, 2, 1])],
             rnd.choice(["Goalkeeper", "Back", None]), rnd.choice([True, False, False, None]))
            for _ in range(rnd.randint(0, 6))]
        rows.append((i, frame, rnd.uniform(80, 119), rnd.uniform(1, 79)))
    data = [(i, f and [(loc, (n,), m) for loc, n, m in f] if f is not None else None, x, y)
            for i, f, x, y in rows]
    df = spark.createDataFrame(data, "i int, f array<struct<location:array<double>,"
                                     "position:struct<name:string>,teammate:boolean>>, x double, y double")
    out = df.select("i", *X.freeze_frame_features(F.col("f"), F.col("x"), F.col("y")).values())
    for i, *got in out.collect():
        want = plain_frame(rows[i][1], rows[i][2], rows[i][3])
        for g, w in zip(got, want, strict=True):
            assert g == pytest.approx(w) if w is not None else g is None, (i, got, want)


def test_display_frame_reads_missing_flag_as_opponent(spark):
    df = spark.createDataFrame([([([1.0, 2.0], ("Goalkeeper",), None), ([1.0], None, True)],)],
                               "f array<struct<location:array<double>,"
                               "position:struct<name:string>,teammate:boolean>>")
    assert [tuple(p) for p in df.select(X.players_on_frame(F.col("f"))).first()[0]] == \
        [(1.0, 2.0, False, True)]
