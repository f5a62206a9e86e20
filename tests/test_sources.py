"""VARIANT records with their quarantine, keyed tables, latent vectors, refined selection."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ingest import EVENTS, event

from fieldseq.operators import latent, order_stats
from fieldseq.sources import keyed, raw, readers

BROKEN = {"not JSON": '{"id": "x", "index": 1', "not an object": "[1, 2]", "missing type.name": json.dumps({"id": "a", "index": 1}),
          "bad index": json.dumps(event(50, "first", "Pass")), "bad location": json.dumps(event(51, 3, "Pass", x="left")),
          "bad shot.freeze_frame": json.dumps(event(52, 4, "Shot", shot={"freeze_frame": [{"location": "here"}]})),
          "bad pass": json.dumps(event(53, 5, "Pass", **{"pass": 7})), "missing id": json.dumps({"index": 2, "type": {"name": "Pass"}})}


def test_sound_records_equal_the_fixed_schema_and_broken_ones_are_kept(spark, tmp_path):
    (tmp_path / "77.json").write_text(json.dumps(EVENTS))
    (tmp_path / "78.json").write_text('[{"id": "cut')
    want = {r.event_id: r for r in readers.flatten_events(
        readers.read_events(spark, str(tmp_path / "77.json"))).collect()}
    records = raw.checked(raw.array_records(spark, str(tmp_path)).withColumn("match_id", F.lit(77).cast("long")))
    got = {r.event_id: r for r in readers.flatten_events(raw.sound_events(records, "match_id")).collect()}
    assert got == want and len(got) == len(EVENTS)
    assert [(r.text, r.problems) for r in raw.quarantine(records).collect()] == [('[{"id": "cut', ["not JSON"])]

    (tmp_path / "lines").mkdir()
    lines = [json.dumps(e) for e in EVENTS] + list(BROKEN.values()) + ["", json.dumps(event(60, 6, "Pass", carry=None))]
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join(lines))
    records = raw.checked(raw.record_lines(spark, str(tmp_path / "lines"))).cache()
    assert raw.sound_events(records).count() == len(EVENTS) + 1
    found = {r.text: r.problems for r in raw.quarantine(records).collect()}
    assert set(found) == set(BROKEN.values())
    assert all(reason in found[text] for reason, text in BROKEN.items())


def rows(spark, *data):
    return spark.createDataFrame(list(data), "id int, part string, v string, kept string")


def test_moved_keys_leave_their_old_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    at = (path, ["id"], ["part"])

    def now():
        return sorted(tuple(r) for r in keyed.stored_rows(spark, path).select("id", "part", "v", "kept").collect())
    keyed.upsert(rows(spark, (1, "a", "x", "k1"), (2, "b", "y", "k2"), (3, "b", "z", "k3"), (4, "c", "w", "k4")), *at, buckets=4)
    keyed.upsert(rows(spark, (1, "b", "moved", "other"), (5, "d", "new", "k5")), *at, keep={"kept": ""}, buckets=4)
    assert now() == [(1, "b", "moved", "k1"), (2, "b", "y", "k2"), (3, "b", "z", "k3"), (4, "c", "w", "k4"), (5, "d", "new", "k5")]
    keyed.upsert(rows(spark, (3, "c", "1", ""), (3, "a", "2", ""), (1, "b", "again", "")), *at, version=F.col("v"), buckets=4)
    want = [(1, "b", "again", ""), (2, "b", "y", "k2"), (3, "a", "2", ""), (4, "c", "w", "k4"), (5, "d", "new", "k5")]
    assert now() == want
    keyed.upsert(rows(spark, (3, "a", "2", "")), *at, buckets=4)  # the same again changes nothing
    assert now() == want
    wanted = spark.createDataFrame([(1,), (4,), (99,)], "id int")
    found = keyed.lookup(spark, path, ["id"], ["part"], wanted, 4)
    assert sorted((r.id, r.part) for r in found.collect()) == [(1, "b"), (4, "c")]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1][:40]


def test_interrupted_update_is_repaired_by_the_next_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    at = (path, ["id"], ["part"])
    keyed.upsert(rows(spark, (1, "a", "x", ""), (2, "b", "y", "")), *at, buckets=4)

    def die(*_):
        raise RuntimeError("executor lost")
    monkeypatch.setattr(keyed, "_remove", die)
    with pytest.raises(RuntimeError):
        keyed.upsert(rows(spark, (1, "b", "new", "")), *at, buckets=4)
    monkeypatch.undo()
    keyed.upsert(rows(spark, (1, "b", "new", "")), *at, buckets=4)
    assert sorted((r.id, r.part, r.v) for r in keyed.stored_rows(spark, path).collect()) == [(1, "b", "new"), (2, "b", "y")]


def test_many_partitions_are_found_by_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "NAMED", 2)
    path = str(tmp_path / "t")
    keyed.upsert(rows(spark, *[(i, f"p{i % 5}", "x", "") for i in range(20)]), path, ["id"], ["part"], buckets=3)
    keyed.upsert(rows(spark, *[(i, f"p{i % 4}", "y", "") for i in range(10)]), path, ["id"], ["part"], buckets=3)
    got = sorted((r.id, r.part) for r in keyed.stored_rows(spark, path).collect())
    assert got == [(i, f"p{i % 4}" if i < 10 else f"p{i % 5}") for i in range(20)]


def test_latent_vectors_against_a_full_decomposition(spark):
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(60, 3)), rng.normal(size=(3, 25))
    m = left @ right * (rng.random((60, 25)) < 0.8) + 0.01 * rng.normal(size=(60, 25))
    postings = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(60) for j in range(25) if m[i, j]],
                                     "uid int, gram string, weight double")
    found = latent.fit(postings, rank=4, rounds=12)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(found.singular[:3], s[:3], rtol=1e-6) and abs(found.explained - (s[:4] ** 2).sum() / (m ** 2).sum()) < 1e-4
    assert np.allclose(latent.inner_products(found.grams, 4), np.eye(4), atol=1e-9)
    mine = {r.gram: r.v for r in found.grams.collect()}
    first = np.array([mine[f"g{j}"] for j in range(25)])
    assert np.allclose(np.abs(first[:, 0] @ vt[0]), 1, atol=1e-9)
    own = {r.uid: np.array(r.v) for r in found.items.collect()}
    assert np.allclose([own[i] for i in range(60)], m @ first, atol=1e-9)
    flat = spark.createDataFrame([(i, "only", 1.0) for i in range(5)], "uid int, gram string, weight double")
    assert len(latent.fit(flat, rank=3, rounds=2).singular) == 1


@pytest.mark.parametrize("limit", [3, 40, 10 ** 6])
def test_selection_is_exact_at_any_limit(spark, limit):
    """Most rows share a value, the others crowd in a corner; two groups of unlike size."""
    rnd = random.Random(1)
    values = [0.5] * 3000 + [0.5 + rnd.random() * 1e-6 for _ in range(700)] + [rnd.random() for _ in range(20)]
    data = [("a", v) for v in values] + [("b", 0.1), ("b", 0.5)]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    got = {(r.g, r.v): (r.n, r.before, r.total) for r in order_stats.cumulative(df, "v", ["g"], limit=limit).collect()}
    for g in "ab":
        own = sorted(v for k, v in data if k == g)
        assert {v: got[g, v] for v in own} == {v: (own.count(v), own.index(v), len(own)) for v in own}
    counted = df.groupBy("g", "v").count()
    sizes = order_stats.in_buckets(counted, "v", ["g"], limit).groupBy("g", "_bucket").count().agg(F.max("count")).first()[0]
    assert sizes <= limit
