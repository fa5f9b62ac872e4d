"""The logged ego's cycles and metrics on a made scene, areas by cells against every edge, and distances of boxes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import geometry
from tarnspark.operators import cycles, logged, routes, scene

TRACK = "scenario_id long, agent_idx int, step int, valid boolean, kind string, x double, y double, heading double, vx double, vy double, length double, width double"
LANE = "scenario_id long, lane_idx long, points array<struct<x: double, y: double>>, lane_type string, speed_prior double, is_intersection boolean, has_stop_sign boolean"


def test_metrics_of_a_logged_ego(spark):
    """10 m/s along a lane of 100 m at 0.1 s; a step without a sample, a stop sign of a car at the end, an area that ends 2 m before it."""
    ego = [(1, 0, i, i != 20, "vehicle", float(i), 0.0, 0.0, 10.0, 0.0, 4.8, 2.0) for i in range(61)]
    car = [(1, 1, i, True, "vehicle", 60.0, 0.0, 0.0, 0.0, 0.0, 4.8, 2.0) for i in range(61)] + [(1, 2, i, True, "static", 30.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0) for i in range(61)]
    other = [(2, 1, 0, True, "vehicle", 0.0, 0.0, 0.0, 0.0, 0.0, 4.8, 2.0), (3, 0, 0, True, "vehicle", 0.0, 900.0, 0.0, 1.0, 0.0, 4.8, 2.0)]
    tracks = spark.createDataFrame(ego + car + other, TRACK)
    lanes = spark.createDataFrame([(1, 0, [(0.0, 0.0), (100.0, 0.0)], "VEHICLE", 9.0, False, False), (3, 0, [(0.0, 0.0), (9.0, 0.0)], "VEHICLE", 9.0, False, False)], LANE)
    areas = spark.createDataFrame([(1, [(-5.0, -2.0), (56.4, -2.0), (56.4, 2.0), (-5.0, 2.0)])], "scenario_id long, ring array<struct<x: double, y: double>>")
    graph = routes.lane_graph(lanes)
    asked = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 60.0, 0.0), (3, 3, 0.0, 900.0, 0.0, 5.0, 0.0)], "scenario_id long, request_id long, x double, y double, heading double, goal_x double, goal_y double")
    none = spark.createDataFrame([], "scenario_id long, src long, dst long, kind string")
    found = routes.find_routes(graph, none, asked)
    paths = routes.reference_paths(found, graph)
    rows = {r["step"]: r for r in logged.logged_cycles(tracks, lanes, areas, paths, dt=0.1).collect()}
    assert sorted(rows) == list(range(60))  # the last step has no cycle
    assert (rows[19]["x"], rows[20]["x"], rows[21]["x"]) == (19.0, 19.0, 21.0) and rows[20]["log_x"] is None and rows[20]["v"] == pytest.approx(10)
    assert rows[10]["s"] == pytest.approx(10) and rows[10]["speed_prior"] == 9 and rows[10]["heading_error"] == pytest.approx(0) and rows[10]["path_length"] == pytest.approx(100, abs=0.5)
    assert [i for i, r in rows.items() if r["collision_agent"] is not None] == list(range(56, 60)) and rows[56]["collision_agent"] == 1 and not rows[56]["ego_struck_from_behind"]
    assert rows[50]["min_ttc"] == pytest.approx(0.6) and rows[10]["min_ttc"] is None and rows[59]["offroad"] == pytest.approx(5.0) and rows[50]["offroad"] == 0
    kinematics = {r["step"]: r for r in logged.ego_states(tracks, 0.1).where("scenario_id = 1").collect()}
    assert kinematics[0]["a_lon"] == 0 and max(abs(r["a_lon"]) for r in kinematics.values()) < 1e-6 and kinematics[5]["jerk"] == pytest.approx(0, abs=1e-6)
    m = cycles.scenario_metrics(logged.logged_cycles(tracks, lanes, areas, paths, dt=0.1)).first()
    assert (m["n_cycles"], m["collision"], m["at_fault_collision"], m["drivable_area_violation"], m["wrong_direction"]) == (60, 1, 1, 1, 0)
    assert m["collision_time"] == pytest.approx(5.6) and m["progress_ratio"] == pytest.approx(59 / 57) and m["speeding_frac"] == 1.0 and m["max_abs_a_lon"] is None and m["comfort_violation"] is None and m["ade"] == 0
    assert m["route_completion"] == pytest.approx(59 / m["route_completion"] / 100 * m["route_completion"], abs=0.01)
    got = {r["scenario_id"]: (r["status"], r["failure"]) for r in logged.statuses(tracks, found, paths).collect()}
    assert got == {1: ("ok", None), 2: ("load_fail", "no_ego"), 3: ("no_route", "no_start_lane")}


def test_areas_by_cells_equal_every_edge(spark):
    draw = random.Random(8)
    star = lambda cx, cy, r: [(cx + r * (1 + 0.5 * math.sin(5 * a)) * math.cos(a), cy + r * (1 + 0.5 * math.sin(5 * a)) * math.sin(a)) for a in (2 * math.pi * i / 40 for i in range(40))]
    rings = {1: [star(0, 0, 30), star(60, 10, 20), star(0, 0, 30)], 2: [star(-200, 300, 90)], 3: [[(0.0, 0.0), (1.0, 1.0)]]}
    points = [(s, i, draw.uniform(-400, 400) / (1 + i % 4), draw.uniform(-400, 400) / (1 + i % 4)) for s in (1, 2, 3, 4) for i in range(150)]
    areas = spark.createDataFrame([(s, r) for s, rs in rings.items() for r in rs], "scenario_id long, ring array<struct<x: double, y: double>>")
    got = {(r["scenario_id"], r["point_id"]): (r["inside"], r["distance"]) for r in scene.area_distances(spark.createDataFrame(points, "scenario_id long, point_id long, x double, y double"), areas).collect()}
    assert len(got) == len(points)
    n_inside = 0
    for s, i, x, y in points:
        whole = [r for r in rings.get(s, []) if len(r) > 2]
        if not whole:
            assert got[s, i] == (None, None)
            continue
        inside, away = False, math.inf
        for ring in whole:
            odd = False
            for (ax, ay), (bx, by) in zip([ring[-1], *ring[:-1]], ring, strict=True):
                if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                    odd = not odd
                t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                away = min(away, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
            inside = inside or odd
        n_inside += inside
        assert got[s, i][0] == inside and got[s, i][1] == pytest.approx(0.0 if inside else away, abs=1e-9)
    assert n_inside > 5


def test_box_distances(spark):
    rows = [(0, 0, 0, 4, 2, 10, 0, 0, 4, 2, 6.0), (0, 0, 0, 4, 2, 3, 0, 0, 4, 2, 0.0), (0, 0, 0, 4, 2, 5, 4, 0, 4, 2, math.hypot(1, 2)), (0, 0, 0, 4, 2, 0, 5, math.pi / 2, 4, 2, 2.0), (0, 0, 0, 8, 8, 0, 0, 1, 1, 1, 0.0)]
    names = [f"{a}{i}" for i in (1, 2) for a in ("x", "y", "h", "l", "w")]
    d = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in [*names, "want"]))
    got = d.select("want", geometry.box_distance(tuple(F.col(n) for n in names[:5]), tuple(F.col(n) for n in names[5:])).alias("got")).collect()
    assert [r["got"] for r in got] == pytest.approx([r["want"] for r in got], abs=1e-9)
