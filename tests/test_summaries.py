"""Cited summaries and rubrics."""

import random

import pytest
from pyspark.sql import functions as F

from fieldseq.operators import notes, rubrics
from fieldseq.operators.possessions import zone_line

ROW = ("qid string, rank int, uid string, team string, opponent string, play_pattern string, "
       "zone_path string, n_events int, duration_s double, ended_in_shot boolean, "
       "ended_in_goal boolean, xg_sum double, my_xg_sum double")


def row(i, qid="q", team="Spain", shot=True, goal=False, xg=0.1, pattern="Regular Play",
        zones="D-C M-C F-C", n=10, dur=12.0, mine=None):
    return (qid, i, f"1:{i}", team, "Italy", pattern, zones, n, dur, shot, goal, xg, mine)


def made(spark, rows, given=None):
    df = spark.createDataFrame(rows, ROW)
    table = None if given is None else spark.createDataFrame([("q", given)],
                                                             "qid string, given array<string>")
    out = notes.claims(df, table)
    assert notes.unsupported(out, df).count() == 0
    return {r.kind: r for r in out.orderBy("claim_no").collect()}


def test_text_and_citations(spark):
    got = made(spark, [row(0), row(1, goal=True, xg=0.5), row(2, team="France", shot=False), row(3)])
    assert list(got) == ["team", "pattern", "shots", "goals", "finish"]
    assert got["team"].text == "Spain: 3 of 4 results."
    assert got["team"].uids == ["1:0", "1:1", "1:3"]
    assert got["pattern"].text == "Usual start: regular play, 4 times."
    assert got["shots"].text == "Shots close 3 of 4 sequences, mean value 0.23 xG."
    assert got["goals"].text == "Goals: 1 of 4, mean value 0.50 xG."
    assert got["goals"].uids == ["1:1"]
    assert got["finish"].text == "Usual last zone: F-C, 4 of 4."


def test_tempo_and_standout(spark):
    given = ["team", "play_pattern", "ended_in_shot", "end_zone"]
    got = made(spark, [row(0, n=1, xg=0.2), row(1, n=1, xg=0.4, mine=0.1)], given)
    assert list(got) == ["chance", "tempo", "standout"]
    assert got["tempo"].text == "Tempo short and direct, typically 1 touch in 12 s."
    assert got["standout"].text == "Top chance: Spain v Italy, 0.20 xG."
    assert got["standout"].uids == ["1:0"]


def test_ties_go_to_the_first_seen(spark):
    got = made(spark, [row(0, team="B"), row(1, team="A"), row(2, team="C"), row(3, team="D"),
                       row(4, team="E"), row(5, team="F")])
    assert got["teams"].label == "B" and got["teams"].support == 6
    assert len(got["teams"].uids) == 6


def test_too_few_rows_say_nothing(spark):
    assert made(spark, [row(0)]) == {}


def test_only_the_first_page_counts(spark):
    got = made(spark, [row(i, team="A" if i < 8 else "B") for i in range(30)])
    assert got["team"].text == "A: 8 of 8 results." and len(got) <= 5


# --- rubrics against plain restatements ---------------------------------------------------

def band(t):
    return zone(t).split("-")[0]


def zone(t):
    return t.split("@")[1].rstrip("+>^")


def side(z):
    return {"L": "L", "LI": "L", "R": "R", "RI": "R"}.get(z.split("-")[1], "C")


BOX = ("SHOT@F-LI", "SHOT@F-C", "SHOT@F-RI")


def restated(ts, zs, n, shot):
    shots = [i for i, t in enumerate(ts) if t.startswith("SHOT")]
    after = lambda i: any(s > i for s in shots)
    third = any(band(t) == "F" for t in ts)
    last = zone(ts[shots[-1]]) if shots else ""
    cross = lambda p: any(t.startswith(p) and ">" in t and after(i) for i, t in enumerate(ts))
    box = any(t.startswith(BOX) for t in ts)
    wins = lambda *p: any(t.startswith(p) for t in ts[:2])
    opposite = any(
        zs[i][0] in "MF" and side(zs[i]) != "C" and any(
            zs[j][0] == "D" and any(zs[k][0] == "F" and side(zs[k]) not in ("C", side(zs[i]))
                                    for k in range(j + 1, len(zs)))
            for j in range(i + 1, len(zs))) for i in range(len(zs)))
    run = any(all(z in ("M-C", "F-C") for z in zs[i:i + 4]) for i in range(len(zs) - 3))
    between = any(any(ts[i].startswith(("RECOV", "DUEL")) for i in range(a + 1, b))
                  for a, b in zip(shots, shots[1:]))
    square = any(zone(t) in ("F-L", "F-LI", "F-RI", "F-R") and ">" in t and any(
        u.startswith("SHOT@F-C") for u in ts[i + 1:i + 3]) for i, t in enumerate(ts))
    inside = sum(t.startswith("PASS") and zone(t) in ("M-LI", "F-LI") for t in ts)
    drib = any(t.startswith("DRIB@F") and any(">" in u or u.startswith(BOX) for u in ts[i + 1:])
               for i, t in enumerate(ts))
    return {
        "q01": cross("CROSS@F-R"), "q02": cross("CROSS@F-L"),
        "q03": any(t.startswith("SWITCH") for t in ts), "q04": shot and n <= 25, "q05": box,
        "q06": any(t.startswith("THROUGH") and band(t) != "D" for t in ts), "q07": third,
        "q08": any(t.startswith("SHOT@F") for t in ts),
        "q09": wins("RECOV@F", "INT@F") and bool(shots) and shots[0] <= 8, "q10": drib,
        "q11": zs[-1] in ("F-L", "F-LI") and any(z in ("M-LI", "F-LI") for z in zs),
        "q12": third and n <= 25, "q13": wins("RECOV@M", "RECOV@F", "INT@M", "INT@F"),
        "q14": last.startswith("M-"),
        "q15": "F-R" in zs and any(zone(t) in ("F-R", "F-RI") and ">" in t and after(i)
                                   for i, t in enumerate(ts)),
        "q16": band(ts[0]) == "F", "q17": any(">" in t for t in ts), "q18": opposite,
        "q19": run and third, "q20": last == "F-C",
        "q21": sum("^" in t for t in ts) >= 4 and band(ts[0]) == "D" and any(
            band(t) in "MF" for t in ts),
        "q22": any(a[0] == "D" and b[0] == "F" for a, b in zip(zs, zs[1:])),
        "q23": zs[-1] in ("F-L", "F-LI"),
        "q24": sum(t.startswith(("LOSS", "DUEL")) for t in ts) <= 2, "q25": between,
        "q26": any(z in ("F-R", "M-R") for z in zs) and last == "F-RI",
        "q27": wins("INT@M") and any(band(t) == "F" for t in ts[:8]), "q28": square,
        "q29": inside >= 2 and third, "q30": box}


def test_rubrics_match_plain_python(spark):
    rnd = random.Random(9)
    acts = ["PASS", "CROSS", "THROUGH", "SWITCH", "CARRY", "DRIB", "SHOT", "SHOT", "RECV", "RECOV",
            "DUEL", "INT", "LOSS"]
    rows = []
    for i in range(6000):
        ts = []
        for _ in range(rnd.choice([3, 4, 6, 9, 14, 27])):
            a = rnd.choice(acts)
            mods = rnd.choice(["", "", "^"]) if a == "SHOT" else rnd.choice(
                ["", "", "+", ">", "+>", "^", "+^", "+>^"])
            ts.append(f"{a}@{rnd.choice('DMF')}-{rnd.choice(['L', 'LI', 'C', 'C', 'RI', 'R'])}{mods}")
        rows.append((str(i), " ".join(ts), len(ts), rnd.random() < .5))
    df = spark.createDataFrame(rows, "uid string, token_string string, n_events int, "
                                     "ended_in_shot boolean")
    df = df.withColumn("zone_path", zone_line(F.col("token_string")))
    got = {r.uid: r for r in rubrics.matrix(df).collect()}
    for uid, line, n, shot in rows:
        ts = line.split()
        want = restated(ts, [zone(t) for t in ts], n, shot)
        mine = got[uid].asDict()
        assert {q: bool(mine[q]) for q in want} == {q: bool(v) for q, v in want.items()}, line


def test_unknown_query_id_fails(spark):
    df = spark.createDataFrame([("q99", "PASS@M-C", "M-C", 1, False)],
                               "qid string, token_string string, zone_path string, n_events int, "
                               "ended_in_shot boolean")
    with pytest.raises(Exception, match="no rule for query"):
        df.select(rubrics.judged(F.col("qid"))).collect()
