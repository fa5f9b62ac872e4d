"""Lane graph, routes, reference paths and coordinates along them, against plain versions and known answers."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import lanes, routes
from tarnspark.plans import route_queries
from tarnspark.sources.work import kept

from . import plain_routes as plain

LANE = "scenario_id long, lane_idx long, points array<struct<x: double, y: double>>, lane_type string, speed_prior double, is_intersection boolean, has_stop_sign boolean"
EDGE = "scenario_id long, src long, dst long, kind string"
ASK = "scenario_id long, request_id long, x double, y double, heading double, goal_x double, goal_y double"


def lane(i, *points, kind="VEHICLE", speed=10.0, crossing=False, stop=False, scene=1):
    return scene, i, [tuple(map(float, p)) for p in points], kind, speed, crossing, stop


def test_lane_samples(spark):
    draw = random.Random(4)
    made = {i: [(0.0, 0.0)] + [(draw.uniform(-30, 30), draw.uniform(-30, 30)) for _ in range(draw.randint(1, 6))] for i in range(30)}
    made[30] = [(0.0, 0.0), (0.3, 0.0)]
    made[31] = [(0.0, 0.0), (5.0, 0.0), (5.0, 0.0), (10.0, 0.0)]
    rows = [lane(i, *p) for i, p in made.items()] + [lane(40, (1, 1), (1, 1)), lane(41, (1, 1)), lane(42)]
    got = {r["lane_idx"]: r for r in routes.lane_graph(spark.createDataFrame(rows, LANE)).collect()}
    assert set(got) == set(made)
    for i, pts in made.items():
        want, cum = plain.lane(pts)
        heading, curve = plain.shape(want)
        own = got[i]["samples"]
        assert [p["i"] for p in own] == list(range(len(want))) and got[i]["length"] == pytest.approx(cum[-1])
        for p, q, s, h, c in zip(own, want, cum, heading, curve, strict=True):
            assert (p["x"], p["y"], p["s"], p["curvature"]) == pytest.approx((*q, s, c), abs=1e-6) and abs(plain.wrap(p["heading"] - h)) < 1e-6
    assert len(got[30]["samples"]) == 2 and len(got[31]["samples"]) == 11
    at = lambda s: spark.createDataFrame(rows, LANE).transform(routes.lane_graph).where("lane_idx = 31").select(*routes.lane_pose(F.col("samples"), F.lit(s))).first()
    assert tuple(at(2.5)) == pytest.approx((2.5, 0, 0)) and tuple(at(-1.0)) == pytest.approx((0, 0, 0)) and tuple(at(99.0)) == pytest.approx((10, 0, 0))


def test_a_lane_over_the_limit_raises(spark):
    with pytest.raises(Exception, match="has over 65536 samples"):
        routes.lane_graph(spark.createDataFrame([lane(1, (0, 0), (1e7, 0))], LANE)).collect()


def test_route_costs_and_outcomes(spark):
    rows = [lane(0, (0, 0), (40, 0)), lane(1, (40, 0), (80, 0), crossing=True), lane(2, (80, 0), (120, 0), stop=True), lane(3, (0, 3.5), (40, 3.5), speed=1.0), lane(4, (40, 0), (40, 40)), lane(5, (500, 0), (540, 0))]
    rows += [lane(0, (0, 0), (40, 0), kind="BIKE", scene=2)]
    edges = [(1, 0, 1, "succ"), (1, 1, 2, "succ"), (1, 0, 3, "left"), (1, 3, 0, "right"), (1, 0, 4, "succ"), (1, 1, 0, "pred")]
    asked = [
        (1, 1, 10.0, 0.5, 0.0, 110.0, 2.0), (1, 2, 10.0, 3.0, 0.0, 110.0, 0.0), (1, 3, 10.0, 0.0, 0.0, 40.0, 39.0), (1, 4, 10.0, 0.0, 3.0, 110.0, 0.0), (1, 5, 10.0, 9.0, 0.0, 110.0, 0.0), (1, 6, 10.0, 0.0, 0.0, 110.0, 60.0),
        (1, 7, 10.0, 0.0, 0.0, 520.0, 0.0), (2, 8, 10.0, 0.0, 0.0, 30.0, 0.0), (3, 9, 10.0, 0.0, 0.0, 30.0, 0.0), (1, 10, 10.0, 0.0, 0.0, 30.0, 0.0),
    ]
    graph = routes.lane_graph(spark.createDataFrame(rows, LANE))
    got = {r["request_id"]: r for r in routes.find_routes(graph, spark.createDataFrame(edges, EDGE), spark.createDataFrame(asked, ASK)).collect()}
    way = lambda i: [(h["lane_idx"], h["lane_change"]) for h in got[i]["route"]]
    assert {i: r["status"] for i, r in got.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "no_start_lane", 5: "no_start_lane", 6: "no_goal_lane", 7: "unreachable", 8: "no_lanes", 9: "no_lanes", 10: "ok"}
    assert way(1) == [(0, False), (1, False), (2, False)] and got[1]["cost"] == pytest.approx(3 + 4 + 1.5 + 4 + 2) and (got[1]["start_s"], got[1]["goal_s"]) == pytest.approx((10, 30))
    # The pose lies 3 m beside lane 0, so that lane costs a change; lane 3, in which it is, costs half a minute to its end.
    assert way(2) == [(0, True), (1, False), (2, False)] and got[2]["cost"] == pytest.approx(got[1]["cost"] + 4)
    assert way(3) == [(0, False), (4, False)] and got[3]["cost"] == pytest.approx(3 + 4 + 2 * math.pi / 2)
    assert way(10) == [(0, False)] and got[10]["cost"] == pytest.approx(3) and got[7]["route"] is None and got[7]["cost"] is None
    none = spark.createDataFrame([], ASK)
    assert routes.find_routes(graph, spark.createDataFrame(edges, EDGE), none).count() == 0


def test_cheapest_against_all_ways():
    draw = random.Random(9)
    for _ in range(200):
        n = draw.randint(1, 7)
        edges = [{"src": draw.randrange(n), "dst": draw.randrange(n), "cost": draw.uniform(0, 5), "lane_change": draw.random() < 0.5} for _ in range(draw.randint(0, 14))]
        starts = [{"lane_idx": draw.randrange(n), "cost": draw.uniform(0, 5), "lane_change": False} for _ in range(draw.randint(1, 3))]
        goals = {draw.randrange(n)}
        best = {}
        for s in starts:
            best[s["lane_idx"]] = min(best.get(s["lane_idx"], math.inf), s["cost"])
        for _ in range(n):
            for e in edges:
                if e["src"] in best:
                    best[e["dst"]] = min(best.get(e["dst"], math.inf), best[e["src"]] + e["cost"])
        want = min((best[g] for g in goals if g in best), default=None)
        got = routes.cheapest(edges, starts, goals)
        assert (got is None) == (want is None) and (got is None or math.isclose(got[0], want, rel_tol=1e-9))


def same_path(own, points, r):
    want = plain.reference_path(points, [tuple(h) for h in r["route"]], r["start_s"])
    assert len(own) == len(want)
    for i, (p, q) in enumerate(zip(own, want, strict=True)):
        assert (p["i"], p["lane_idx"], p["s"]) == (i, q[4], i * 0.5)
        assert (p["x"], p["y"]) == pytest.approx(q[:2], abs=1e-6) and abs(plain.wrap(p["heading"] - q[2])) < 1e-5 and p["curvature"] == pytest.approx(q[3], abs=1e-4)


def test_a_path_over_a_lane_change(spark):
    """The change is blended over 25 m; shared ends of lanes that follow each other are one point; a path of under two steps is none."""
    rows = [lane(0, (0, 0), (40, 0)), lane(1, (40, 0), (60, 2), (80, 1)), lane(2, (40, 3.5), (60, 5.5), (130, 4.5)), lane(3, (500, 0), (500.8, 0))]
    edges = [(1, 0, 1, "succ"), (1, 1, 2, "left")]
    asked = [(1, 1, 5.0, 0.2, 0.1, 125.0, 4.0), (1, 2, 500.1, 0.0, 0.0, 500.5, 0.0)]
    graph = routes.lane_graph(spark.createDataFrame(rows, LANE))
    found = routes.find_routes(graph, spark.createDataFrame(edges, EDGE), spark.createDataFrame(asked, ASK))
    r = {x["request_id"]: x for x in found.collect()}
    assert [tuple(h) for h in r[1]["route"]] == [(0, False), (1, False), (2, True)] and r[2]["status"] == "ok"
    got = {x["request_id"]: x["path"] for x in routes.reference_paths(found, graph).collect()}
    assert set(got) == {1}
    same_path(got[1], {x[1]: x[2] for x in rows}, r[1])


def test_paths_against_plain_version(spark, sf_dir):
    graph, found = route_queries.found(spark, sf_dir)
    points = {r["lane_idx"]: [tuple(p) for p in r["points"]] for r in route_queries.road(spark, sf_dir).collect()}
    got = {r["request_id"]: r for r in routes.reference_paths(found, graph).collect()}
    ok = [r for r in found.collect() if r["status"] == "ok"]
    assert len(ok) > 3
    for r in ok:
        same_path(got[r["request_id"]]["path"] if r["request_id"] in got else [], points, r)
    paths = {i: [(p["x"], p["y"]) for p in r["path"]] for i, r in got.items()}
    events = {r["event_id"]: r for r in route_queries._states(spark, sf_dir).collect()}
    along = route_queries.r5_frenet(spark, sf_dir).collect()
    assert len(along) > 100
    for r in along:
        e = events[r["point_id"]]
        s, d = plain.frenet(paths[r["request_id"]], e["x"] * 1.2, e["k"] % 10 - 4)
        at_sample = abs(r["s"] * 2 - round(r["s"] * 2)) < 1e-9  # there two segments are equally near, and rounding decides whose normal counts
        assert r["s"] == pytest.approx(s, abs=1e-5) and r["d"] == pytest.approx(d, abs=1e-5, rel=0.05 if at_sample else 0)
        assert r["ds"] ** 2 + r["dd"] ** 2 == pytest.approx((e["k"] / 4) ** 2, abs=1e-4)


def test_frenet_places_that_are_not_there(spark):
    sample = "array<struct<i: long, s: double, x: double, y: double, heading: double, curvature: double, speed_prior: double, lane_idx: long, is_intersection: boolean>>"
    straight = [(i, i * 0.5, i * 0.5, 0.0, 0.0, 0.0, 7.0, 3, i > 3) for i in range(8)]
    paths = spark.createDataFrame([(1, 3.5, straight), (2, 0.0, straight[:1]), (3, 0.0, None), (4, 0.5, [straight[0], straight[0]])], f"scenario_id long, length double, path {sample}")
    rows = [(1, 0, 1.2, 0.5, 0.0, 2.0), (1, 1, None, 0.5, 0.0, 2.0), (1, 2, float("nan"), 0.5, 0.0, 2.0), (1, 3, 9.0, 9.0, None, 2.0), (1, 4, -3.0, -1.0, 0.0, None), (2, 5, 0.0, 0.0, 0.0, 1.0), (3, 6, 0.0, 0.0, 0.0, 1.0), (4, 7, 0.0, 0.0, 0.0, 1.0), (5, 8, 0.0, 0.0, 0.0, 1.0)]
    kind = "scenario_id long, point_id long, x double, y double, heading double, v double"
    got = {r["point_id"]: r for r in routes.to_frenet(spark.createDataFrame(rows, kind), paths, ["scenario_id"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 7]  # no path, or none of two samples, no row
    assert (got[0]["s"], got[0]["d"], got[0]["ds"], got[0]["dd"], got[0]["is_intersection"]) == pytest.approx((1.2, 0.5, 2.0, 0.0, False))
    for i in (1, 2, 7):  # no place, no finite one, a path without length
        assert [got[i][a] for a in ("s", "d", "ds", "dd", "speed_prior", "lane_idx", "is_intersection")] == [None] * 7
    assert (got[3]["s"], got[3]["d"], got[3]["ds"], got[3]["lane_idx"], got[3]["is_intersection"]) == (3.5, 9.0, None, 3, True)
    assert (got[4]["s"], got[4]["d"], got[4]["dd"]) == (0.0, -1.0, None)
    assert routes.to_frenet(spark.createDataFrame([], kind), paths, ["scenario_id"]).count() == 0


def test_nearest_samples_in_blocks(monkeypatch):
    monkeypatch.setattr(routes, "CELLS", 7)
    rng = np.random.default_rng(5)
    x, y, qx, qy = (rng.integers(0, 6, n).astype(float) for n in (50, 50, 5, 5))
    want = [min(range(5), key=lambda i: ((x[k] - qx[i]) ** 2 + (y[k] - qy[i]) ** 2, i)) for k in range(50)]
    assert routes.nearest_samples(x, y, qx, qy).tolist() == want


def test_frenet_round_trip(spark):
    rows = [lane(0, (0, 0), (30, 40))]
    graph = routes.lane_graph(spark.createDataFrame(rows, LANE))
    r = spark.createDataFrame([(1, 5, "ok", 1.0, 0.0, 50.0, [(0, False)])], "scenario_id long, request_id long, status string, cost double, start_s double, goal_s double, route array<struct<lane_idx: long, lane_change: boolean>>")
    path = routes.reference_paths(r, graph)
    asked = [(i, s, d) for i, (s, d) in enumerate([(0.0, 0.0), (0.3, 1.0), (17.77, -2.5), (49.2, 3.0), (25.0, 0.0)])]
    at = path.crossJoin(spark.createDataFrame(asked, "point_id long, s double, d double")).select("scenario_id", "request_id", "point_id", routes.to_cartesian(F.col("path"), F.col("s"), F.col("d")).alias("p"))
    back = routes.to_frenet(at.select("scenario_id", "request_id", "point_id", "p.x", "p.y", F.lit(0.0).alias("heading"), F.lit(2.0).alias("v")), path, ["scenario_id", "request_id"])
    for f in back.collect():
        assert (f["s"], f["d"]) == pytest.approx(asked[f["point_id"]][1:], abs=1e-6)
        assert (f["ds"], f["dd"], f["lane_idx"]) == pytest.approx((2 * 0.6, -2 * 0.8, 0), abs=1e-6)
    features = lanes.path_features(routes.route_features(r, path, graph)).first()
    assert features["route_len_m"] in (49.5, 50.0) and features["max_abs_curvature"] < 1e-9 and features["route_lane_changes"] == 0


def test_polylines_are_not_broadcast(spark):
    graph = kept(routes.lane_graph(spark.createDataFrame([lane(0, (0, 0), (30, 40)), lane(1, (30, 40), (60, 80))], LANE)), "lane-graph")
    asked = spark.createDataFrame([(1, 5, 1.0, 1.0, 0.9, 50.0, 66.0)], ASK)
    r = kept(routes.find_routes(graph, spark.createDataFrame([(1, 0, 1, "succ")], EDGE), asked), "routes")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(routes.reference_paths(r, graph))
    paths = kept(routes.reference_paths(r, graph), "paths")
    points = kept(asked.select("scenario_id", "request_id", F.lit(1).alias("point_id"), "x", "y", "heading", F.lit(1.0).alias("v")), "points")
    of = lanes.lane_matches(points.drop("request_id"), graph.select("scenario_id", "lane_idx", F.transform("samples", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")), 4.0)
    for d in (routes.to_frenet(points, paths, ["scenario_id", "request_id"]), routes.route_features(r, paths, graph), of):
        assert re.search(r"\w+Join", plan(d)).group() == "SortMergeJoin"
        assert d.count()
