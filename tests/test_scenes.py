"""Scene views and dumps, cycle traces, and predicates of whole doubles and digit strings."""

from __future__ import annotations

import json

import pytest

from tarnspark.operators import miner, trace
from tarnspark.sources import scenes

TRACK = "scenario_id long, agent_idx int, step int, valid boolean, kind string, x double, y double, heading double, vx double, vy double, length double, width double"


def views(spark):
    tracks = [(1, a, i, a != 1 or i != 1, "vehicle", float(10 * a + i), 0.0, 0.0, 3.0, 4.0, 4.8, 2.0) for a in (2, 0, 1) for i in (2, 0, 1)] + [(2, 1, 0, True, "bus", 0.0, 0.0, 0.0, 0.0, 0.0, 12.0, 2.5)]
    lanes = spark.createDataFrame([(1, 1, [(0.0, 1.0), (5.0, 1.0)], True), (1, 0, [(0.0, 0.0), (5.0, 0.0)], False)], "scenario_id long, lane_idx long, points array<struct<x: double, y: double>>, is_intersection boolean")
    areas = spark.createDataFrame([(1, "drivable_area", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "scenario_id long, kind string, ring array<struct<x: double, y: double>>")
    meta = spark.createDataFrame([(1, 0.1, [5.0, 6.0]), (2, 0.1, None)], "scenario_id long, dt double, origin array<double>")
    return scenes.scene_view(spark.createDataFrame(tracks, TRACK), lanes, areas, meta)


def test_view_and_round_trip(spark, tmp_path):
    view = views(spark)
    assert view.schema.simpleString() == scenes.SCENE.simpleString()
    row = view.collect()
    assert [r["scenario_id"] for r in row] == ["1"]  # scene 2 has no ego
    r = row[0]
    assert [s["x"] for s in r["ego"]] == [0, 1, 2] and [s["t"] for s in r["ego"]] == [0, 0.1, 0.2] and r["ego"][0]["v"] == 5 and r["ego"] == r["ego_logged"]
    assert [a["id"] for a in r["agents"]] == ["agent:1", "agent:2"] and [s["valid"] for s in r["agents"][0]["states"]] == [True, False, True]
    assert [x["id"] for x in r["lanes"]] == [0, 1] and r["lanes"][1]["centerline"] == [[0, 1], [5, 1]] and r["polygons"][0]["points"][2] == [1, 1] and r["origin"] == [5, 6]
    assert r["plans"] == [] and r["route"] == [] and r["metrics"] == {}
    scenes.write_scenes(view, str(tmp_path / "v"))
    good, bad = scenes.read_scenes(spark, str(tmp_path / "v"))
    assert bad.count() == 0 and good.collect() == row


def test_bad_dumps_are_quarantined(spark, tmp_path):
    good = {"schema": 1, "scenario_id": "s", "dt": 0.1, "ego": [], "ego_logged": [], "novel": 3}
    files = {"good": good, "old": good | {"schema": 2}, "none": {k: v for k, v in good.items() if k != "schema"}, "no_ego": {k: v for k, v in good.items() if k != "ego"}, "no_dt": good | {"dt": None}}
    for name, x in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=1))
    (tmp_path / "broken.json").write_text('{"schema": 1, "scenario_id"')
    kept, bad = scenes.read_scenes(spark, str(tmp_path), whole_files=True)
    assert [r["scenario_id"] for r in kept.collect()] == ["s"]
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()} == {"old.json": "version 2, not 1", "none.json": "version none, not 1", "no_ego.json": "no ego", "no_dt.json": "no dt", "broken.json": "not readable as JSON of the dump's fields"}


def test_cycle_trace(spark):
    rows = [
        (1, 0, 0, False, 1.0, 0.0, {"a": 0.0, "b": 0.0}), (1, 0, 1, True, 2.0, 0.5, {"a": 1.0, "b": 4.0}), (1, 0, 2, True, 3.0, 1.0, {"a": 3.0, "b": 1.0}), (1, 0, 3, True, 4.0, 1.0, {"a": 3.0, "b": 1.0}),
        (1, 1, 5, False, 1.0, 0.0, {"a": 2.0}), (1, 1, 4, False, 1.0, 0.0, None),
    ]
    d = spark.createDataFrame(rows, "scenario_id long, step int, candidate int, feasible boolean, target_v double, target_d double, terms map<string, double>")
    got = {r["step"]: r for r in trace.cycle_trace(d, {"b": 2.0}).collect()}
    assert (got[0]["n_candidates"], got[0]["n_feasible"], got[0]["chosen"], got[0]["total"], got[0]["costs"]) == (4, 3, 2, 5.0, {"a": 3.0, "b": 2.0})
    assert (got[1]["n_feasible"], got[1]["chosen"], got[1]["total"], got[1]["feasible"]) == (0, 4, 0.0, False)
    terms = sorted((r["term"], r["share"]) for r in trace.trace_terms(trace.cycle_trace(d, {"b": 2.0})).collect())
    assert terms == [("a", 0.6), ("b", 0.4)]


def test_predicates_of_whole_doubles_and_digit_strings(spark):
    rows = [(float(i % 3), str(i % 4), "x" if i % 2 else "7", float(i) / 7, 5.0, float("nan") if i < 3 else float(i % 2)) for i in range(60)]
    d = spark.createDataFrame(rows, "whole double, digits string, mixed string, real double, same double, odd double")
    got = {}
    for p in miner.candidate_predicates(d, d.columns):
        got.setdefault(p.column, []).append((p.op, p.value))
    assert got["whole"] == [(">=", 1.0), ("<", 1.0), (">=", 2.0), ("<", 2.0)] and [v for op, v in got["digits"] if op == "<"] == [1.0, 2.0, 3.0]
    assert sorted(got["mixed"]) == [("=", "7"), ("=", "x")] and len(got["real"]) == 4 and "same" not in got and got["odd"] == [(">=", 1.0), ("<", 1.0)]
    assert d.where(miner.conjunction(d, tuple(p for p in miner.candidate_predicates(d, ["digits"]) if p.op == ">=")[-1:])).count() == 15
