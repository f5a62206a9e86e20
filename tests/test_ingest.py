"""Nested JSON to tables, possession rules, upserts, exports."""

import json

import pytest
from pyspark.sql import functions as F

from fieldseq.operators import possessions as P
from fieldseq.operators.skew import lead_within
from fieldseq.sources import readers, tables


def event(i, index, kind, team="Spain", possession=2, x=50.0, y=40.0, minute=1, second=0, **more):
    return {"id": f"e{i}", "index": index, "period": 1, "minute": minute, "second": second,
            "timestamp": "00:00:01.000", "type": {"name": kind}, "possession": possession,
            "possession_team": {"name": "Spain"}, "team": {"name": team},
            "play_pattern": {"name": "Regular Play"}, "location": [x, y], **more}


EVENTS = [
    event(1, 3, "Pass", x=30.0, second=20, **{"pass": {"end_location": [60.0, 40.0]}}),
    event(2, 1, "Ball Recovery", x=20.0, second=10),
    event(3, 2, "Pressure", team="Italy"),
    event(4, 4, "Carry", x=60.0, carry={"end_location": [104.0, 40.0]}, under_pressure=True),
    event(5, 5, "Shot", x=104.0, second=40, shot={
        "end_location": [120.0, 40.0, 1.2], "statsbomb_xg": 0.25, "outcome": {"name": "Goal"},
        "type": {"name": "Open Play"}, "freeze_frame": [
            {"location": [112.0, 40.0], "position": {"name": "Back"}, "teammate": False},
            {"location": [119.0, 40.0], "position": {"name": "Goalkeeper"}, "teammate": False}]}),
    event(6, 6, "Shot", team="Italy", second=50, shot={"statsbomb_xg": 0.9}),
    event(7, 7, "Pass", possession=3), event(8, 8, "Pass", possession=3),
    event(9, 9, "Pass", possession=None),
    {"id": "e10", "index": 10, "type": {"name": "Half End"}, "possession": 4},
]


@pytest.fixture(scope="module")
def raw_dirs(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "events").mkdir()
    (root / "events" / "77.json").write_text(json.dumps(EVENTS))
    (root / "events" / "99.json").write_text(json.dumps([event(11, 1, "Pass")]))
    for comp, season, status in (("1", "2", "available"), ("3", "4", None)):
        (root / "matches" / comp).mkdir(parents=True)
        (root / "matches" / comp / f"{season}.json").write_text(json.dumps([{
            "match_id": 77, "competition": {"competition_name": f"C{comp}"},
            "season": {"season_name": f"S{season}"}, "match_date": "2024-05-01",
            "home_team": {"home_team_name": "Spain"}, "away_team": {"away_team_name": "Italy"},
            "home_score": 1, "away_score": 0, "match_status_360": status}]))
    return root


def test_match_scan_takes_last_path(spark, raw_dirs):
    rows = readers.read_matches(spark, str(raw_dirs / "matches")).collect()
    assert [(r.match_id, r.competition_id, r.season_id, r.competition, r.has_360, str(r.match_date))
            for r in rows] == [(77, 3, 4, "C3", False, "2024-05-01")]


def test_event_flatten_and_possessions(spark, raw_dirs):
    matches = readers.read_matches(spark, str(raw_dirs / "matches"))
    events = readers.flatten_events(readers.read_events(spark, str(raw_dirs / "events")))
    by_id = {r.event_id: r for r in events.collect()}
    assert by_id["e5"].match_id == 77 and by_id["e5"].end_x == 120.0
    assert by_id["e5"].token == "SHOT@F-C" and by_id["e4"].token == "CARRY@M-C+>^"
    assert by_id["e10"].x is None and by_id["e10"].token is None
    assert by_id["e2"].under_pressure is False
    assert [r.match_id for r in P.skipped_matches(events, matches).collect()] == [99]

    for width in (1 << 17, 2, 1):
        rows = P.build_possessions(events, matches, width=width).collect()
        assert len(rows) == 1
        p = rows[0]
        assert (p.uid, p.team, p.opponent, p.competition) == ("77:2", "Spain", "Italy", "C3")
        assert p.token_string == "RECOV@D-C PASS@D-C+ CARRY@M-C+>^ SHOT@F-C"
        assert p.zone_path == "D-C D-C M-C F-C" and (p.start_zone, p.end_zone) == ("D-C", "F-C")
        assert (p.start_idx, p.end_idx, p.n_events) == (1, 6, 4)
        assert p.duration_s == 40.0 and p.xg_sum == pytest.approx(0.25)
        assert p.ended_in_shot and p.ended_in_goal
        assert p.lexemes.split(" ")[2] == "carry_m_c_prg_box_prs"


def test_shot_flatten(spark, raw_dirs):
    matches = readers.read_matches(spark, str(raw_dirs / "matches"))
    shots = readers.flatten_shots(readers.read_events(spark, str(raw_dirs / "events")), matches)
    rows = {r.event_id: r for r in shots.collect()}
    assert set(rows) == {"e5", "e6"}
    assert rows["e5"].n_def_in_cone == 1 and rows["e5"].gk_off_line == 1.0
    assert rows["e6"].n_def_in_cone is None and rows["e5"].competition_id == 3


def test_companion_listing(spark, raw_dirs):
    assert sorted(r[0] for r in readers.companion_ids(spark, str(raw_dirs / "events")).collect()) \
        == [77, 99]


def test_competitions(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{
        "competition_id": 1, "season_id": 2, "competition_name": "C", "season_name": "S",
        "competition_gender": "female"}]))
    assert tuple(readers.read_competitions(spark, str(tmp_path / "c.json")).first()) == \
        (1, 2, "C", "S", "female")


def test_upsert_replaces_keys_and_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id int, part string, v string, kept string"
    tables.upsert(spark.createDataFrame([(1, "a", "x", "k1"), (2, "b", "y", "k2")], schema), path,
                  ["id"], ["part"])
    tables.upsert(spark.createDataFrame([(1, "a", "new", "other"), (3, "a", "z", "k3")], schema),
                  path, ["id"], ["part"], keep={"kept": ""})
    tables.upsert(spark.createDataFrame([(3, "a", "z", "k3"), (3, "a", "zz", "k3")], schema), path,
                  ["id"], ["part"], version=F.col("v"))
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("id", "part", "v", "kept")
                 .collect())
    assert got == [(1, "a", "new", "k1"), (2, "b", "y", "k2"), (3, "a", "zz", "k3")]


def test_upsert_of_possessions_clears_vector(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([("1:1", "c", "t")], "uid string, competition string, team string")
    tables.upsert_possessions(one, path, ["competition"])
    assert spark.read.parquet(path).first().embedding is None


def test_export_and_round_trips(spark, tmp_path):
    m = spark.createDataFrame([(1, "2024-01-02"), (2, None), (3, "2024-03-01")],
                              "match_id int, match_date string")
    ids = tables.most_recent(m, 2)
    assert sorted(r[0] for r in ids.collect()) == [1, 3]
    tables.export({"matches": (m, ["match_id"])}, str(tmp_path), ids)
    assert spark.read.parquet(str(tmp_path / "matches")).columns == ["match_id"]
    sizes = {r[0]: r[1] for r in tables.export_sizes({"m": m}, ids).collect()}
    assert sizes == {"m": 2, None: 2}
    tables.write_split(spark, str(tmp_path / "s"), ["1:2"], ["3:4"], 10, 5, "sigmoid")
    assert tables.read_split(spark, str(tmp_path / "s")).first().n_test == 5
    labels = tables.audit_table(spark, {"q01|1:2": 1})
    assert tuple(labels.first()) == ("q01", "1:2", 1)
    assert tuple(tables.label_table(spark, {"q01": {"1:2": 0}}).first()) == ("q01", "1:2", 0)


def test_written_uses_the_named_folder(spark):
    df = tables.written(spark.range(5).toDF("n"), "n")
    assert df.count() == 5 and spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_lead_over_ranges(spark, width):
    rows = [(g, i, i * 10 + g, i % 4 != 1) for g in (1, 2) for i in range(0, 40, 1 + g)]
    df = spark.createDataFrame(rows, "g int, i bigint, v int, ok boolean")
    got = {(r.g, r.i): r.n for r in lead_within(df, ["g"], "i", {"v": "n"}, width).collect()}
    some = {(r.g, r.i): r.n for r in lead_within(df, ["g"], "i", {"v": "n"}, width,
                                                 F.col("ok")).collect()}
    for g in (1, 2):
        mine = [r for r in rows if r[0] == g]
        for a, b in zip(mine, [*mine[1:], None], strict=True):
            assert got[g, a[1]] == (b and b[2])
        kept = [r for r in mine if r[3]]
        for a, b in zip(kept, [*kept[1:], None], strict=True):
            assert some[g, a[1]] == (b and b[2])
        assert all(some[g, r[1]] is None for r in mine if not r[3])
