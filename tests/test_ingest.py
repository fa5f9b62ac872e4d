"""Ingest on small maps and tracks, and lane operators with known answers."""

from __future__ import annotations

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import geometry
from tarnspark.operators import lanes, scene
from tarnspark.sources import ingest


def point(x, y):
    return {"x": x, "y": y}


@pytest.fixture(scope="module")
def maps(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("maps")
    lane = lambda i, kind, **k: {"id": i, "lane_type": kind, "is_intersection": i == 2, "centerline": [point(0, i), point(10, i)], "successors": [], "predecessors": [], "left_neighbor_id": None, "right_neighbor_id": None} | k
    segments = {"1": lane(1, "VEHICLE", successors=[2, 9], left_neighbor_id=2), "2": lane(2, "vehicle", predecessors=[1], right_neighbor_id=8), "3": lane(3, "TRAM")}
    areas = {"5": {"area_boundary": [point(0, 0), point(1, 0), point(1, 1)]}, "6": {"area_boundary": [point(0, 0), point(1, 0)]}}
    crossings = {"7": {"edge1": [point(0, 0), point(4, 0)], "edge2": [point(0, 2), point(4, 2)]}}
    (path / "m.json").write_text(json.dumps({"lane_segments": segments, "drivable_areas": areas, "pedestrian_crossings": crossings}))
    return ingest.read_maps(spark, str(path))


def test_lanes_and_edges(maps):
    found = {r["src"]: (r["lane_idx"], r["lane_type"], r["is_intersection"]) for r in ingest.lane_rows(maps).collect()}
    assert found == {1: (0, "VEHICLE", False), 2: (1, "VEHICLE", True)}
    edges, dropped = ingest.lane_edges(maps)
    assert sorted((r["src"], r["dst"], r["kind"]) for r in edges.collect()) == [(1, 2, "left"), (1, 2, "succ"), (2, 1, "pred")]
    assert {r["kind"]: r["n_dropped"] for r in dropped.collect()} == {"succ": 1, "right": 1}


def test_polygons(maps):
    rings = {r["kind"]: [(p["x"], p["y"]) for p in r["ring"]] for r in ingest.polygons(maps).collect()}
    assert rings == {"drivable": [(0, 0), (1, 0), (1, 1)], "crosswalk": [(0, 0), (4, 0), (4, 2), (0, 2)]}


def test_codes(spark):
    d = spark.createDataFrame([(" Austin ", "vehicle"), ("PALO_ALTO", "riderless_bicycle"), ("Rome", "ufo"), (None, None)], "city string, raw string")
    got = ingest.with_footprints(d.select(ingest.city_code(F.col("city")).alias("city"), ingest.agent_kind(F.col("raw")).alias("kind")), {"vehicle": (5.0, 2.5)}).collect()
    assert [tuple(r) for r in got] == [(0, "vehicle", 5.0, 2.5), (5, "cyclist", 1.8, 0.7), (6, "unknown", 1.0, 1.0), (6, "unknown", 1.0, 1.0)]
    names = d.select(scene.city_name(ingest.city_code(F.col("city"))).alias("c")).collect()
    assert [r["c"] for r in names] == ["austin", "palo-alto", "unknown", "unknown"]
    hashed = d.select(ingest.id_hash("raw").alias("h")).collect()
    assert hashed[0]["h"] == int.from_bytes(hashlib.blake2b(b"vehicle", digest_size=8).digest(), "little", signed=True) and hashed[3]["h"] is None


def test_every_reject_reason(spark):
    def track(sid, n=4, ego="AV", first=0, step=2.0):
        return [(sid, ego, first + i, i * step, 0.0) for i in range(n)]

    rows = track("ok") + track("steps", 3) + track("no_ego", ego="x") + track("late", first=1) + track("still", step=1.0) + track("lanes") + track("unread")
    tracks = spark.createDataFrame(rows, "scenario_id string, track_id string, timestep int, position_x double, position_y double")
    names = ["ok", "steps", "no_ego", "late", "still", "lanes", "unread", "gone", "empty"]
    files = spark.createDataFrame([(n, {"unread": "parse_error:ValueError", "gone": "missing_input_files"}.get(n)) for n in names], "scenario_id string, reason string")
    lane = spark.createDataFrame([(n, "VEHICLE") for n in names if n != "lanes" for _ in range(2)] + [("lanes", "VEHICLE"), ("lanes", "BIKE")], "scenario_id string, lane_type string")
    found = ingest.reject_reasons(tracks, lane, files, n_steps=4)
    got = {r["scenario_id"]: r["reason"] for r in found.collect()}
    assert got == {
        "ok": None, "steps": "unexpected_num_timestamps:3", "no_ego": "no_av_track", "late": "av_not_valid_at_t0", "still": "ego_travel_below_5m", "lanes": "fewer_than_2_vehicle_lanes",
        "unread": "parse_error:ValueError", "gone": "missing_input_files", "empty": "empty_parquet",
    }
    told = ingest.manifest(found)
    assert (told["n_scenarios"], told["n_converted"], told["n_rejected"], told["reasons"]["parse_error"]) == (9, 1, 8, 1)


def test_files_of_scenarios(spark):
    listing = spark.createDataFrame([("a", "/d/a/scenario_a.parquet"), ("a", "/d/a/scenario_0.parquet"), ("a", "/d/a/log_map_archive_a.json"), ("b", "/d/b/scenario_z.parquet"), ("b", "/d/b/log_map_archive_y.json"), ("c", "/d/c/scenario_c.parquet")], "scenario_id string, path string")
    got = {r["scenario_id"]: tuple(r)[1:] for r in ingest.scenario_files(listing).collect()}
    assert got == {"a": ("/d/a/scenario_a.parquet", "/d/a/log_map_archive_a.json", None), "b": ("/d/b/scenario_z.parquet", "/d/b/log_map_archive_y.json", None), "c": (None, None, "missing_input_files")}


def test_structural_faults(spark):
    scenarios = spark.createDataFrame([("ok", 5, 110, 3, 50, 0.1, 0), ("many", 5000, 110, 3, 50, 0.1, 0), ("dt", 5, 110, 3, 50, 0.0, 0), ("ego", 5, 110, 3, 50, 0.1, 5)], "scenario_id string, n_agents int, n_steps int, n_lanes int, n_points int, dt double, ego_index int")
    edges = spark.createDataFrame([("ok", 0, 1), ("edge", 0, 7)], "scenario_id string, src int, dst int")
    own = spark.createDataFrame([("ok", 0), ("ok", 1), ("edge", 0)], "scenario_id string, lane_idx int")
    assert {tuple(r) for r in ingest.structural_faults(scenarios, edges, own).collect()} == {("many", "count_over_limit"), ("dt", "dt_out_of_range"), ("ego", "ego_out_of_range"), ("edge", "edge_to_no_lane")}


def test_gated_signals(spark):
    d = spark.createDataFrame([(1, 2, True), (4, 0, False), (0, 5, True)], "caps int, lights int, stop boolean")
    got = d.select(*[c.alias(k) for k, c in scene.signal_features(F.col("caps"), F.col("lights"), F.col("stop")).items()]).collect()
    assert [tuple(r) for r in got] == [(1, "unknown", None), (None, None, 0), (None, None, None)]
    assert [r[0] for r in d.select(scene.agent_density(F.lit(3), F.col("lights").cast("double"))).collect()] == [150.0, 0.0, 60.0]


def test_geometry(spark):
    v = lambda *xs: [F.lit(float(x)) for x in xs]
    row = spark.range(1).select(
        geometry.segments_meet(*v(0, 0, 2, 2, 0, 2, 2, 0)).alias("cross"), geometry.segments_meet(*v(0, 0, 1, 0, 1, 0, 1, 5)).alias("touch"), geometry.segments_meet(*v(0, 0, 1, 0, 2, 0, 3, 0)).alias("apart"),
        geometry.curvature(*v(1, 0, 0, 1, -1, 0)).alias("circle"), geometry.curvature(*v(0, 0, 0, 0, 1, 1)).alias("same"), geometry.lerp_angle(*v(3, -3, 0.5)).alias("half"),
    ).first()
    assert (row["cross"], row["touch"], row["apart"], row["same"]) == (True, True, False, 0.0)
    assert row["circle"] == pytest.approx(1) and abs(row["half"]) == pytest.approx(math.pi)


def test_dt_of_stored_scenes(spark):
    """29 steps of the stored 0.1, 30 of the exact one."""
    schema = "scenario_id long, step int, x double, y double, heading double, vx double, vy double, length double, width double"
    ego = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0, 2.0)], schema)
    other = spark.createDataFrame([(1, 0, 33.95, 0.0, 0.0, -10.0, 0.0, 4.0, 2.0)], schema)  # touches at 2.995 s
    assert scene.time_to_collision(ego, other).first()["min_ttc"] is None
    assert scene.time_to_collision(ego, other, dt=0.1).first()["min_ttc"] == pytest.approx(3.0)


def test_lane_match_prefers_the_aligned_of_two_close_lanes(spark):
    two = spark.createDataFrame([(1, 0, [(0.0, 0.0), (50.0, 0.0)]), (1, 1, [(50.0, 0.1), (0.0, 0.1)]), (1, 2, [(0.0, 3.0), (50.0, 3.0)])], "scenario_id long, lane_idx int, points array<struct<x: double, y: double>>")
    pose = spark.createDataFrame([(1, 7, 10.0, 0.2, 0.0), (1, 8, 10.0, 40.0, 0.0)], "scenario_id long, point_id long, x double, y double, heading double")
    got = lanes.lane_matches(pose, two, 4.0, math.pi).where("point_id = 7").orderBy("rank").collect()
    assert [r["lane_idx"] for r in got] == [0, 1, 2] and got[0]["lateral"] == pytest.approx(0.2) and got[0]["s"] == pytest.approx(10) and got[2]["lateral"] < 0
    assert [r["lane_idx"] for r in lanes.lane_matches(pose, two, 4.0).where("rank = 1").collect()] == [1]
    turned = {r["point_id"]: r["heading_error"] for r in lanes.wrong_direction(pose.withColumn("heading", F.lit(1.0)), two.withColumn("lane_type", F.lit("VEHICLE"))).collect()}
    assert turned[7] == pytest.approx(1.0) and turned[8] is None
