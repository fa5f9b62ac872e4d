"""Operators that SQL does not express, on small tables with known answers."""

from __future__ import annotations

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import stats
from tarnspark.operators import analysis, bootstrap, cycles, lanes, miner, scene
from tarnspark.operators.gate import DIRECTIONS, gate, run_gate
from tarnspark.plans import scene_queries
from tarnspark.sources import ingest, store


def test_cluster_bootstrap_is_wider_than_rows(spark):
    d = spark.createDataFrame([("c", f"k{i:02d}", f"{i}-{j}", float(i % 2)) for i in range(20) for j in range(50)], "cell string, cluster string, own string, value double")
    by_cluster = bootstrap.cluster_bootstrap(d, ["cell"], "cluster", "value", seed=3).first()
    by_row = bootstrap.cluster_bootstrap(d, ["cell"], "own", "value", seed=3).first()
    assert by_cluster["point"] == by_row["point"] == 0.5
    assert by_row["ci_hi"] - by_row["ci_lo"] < 0.08 and by_cluster["ci_hi"] - by_cluster["ci_lo"] > 0.35


def test_miner_finds_the_planted_class(spark):
    rng, rows = random.Random(7), []
    for i in range(2400):
        maneuver, oncoming = rng.choices(["straight", "left", "right", "lane_change"], [55, 15, 15, 15])[0], rng.randrange(5)
        rows.append((f"scn-7-{i:06d}", maneuver, oncoming, rng.uniform(0, 18), int(rng.random() < (0.6 if maneuver == "left" and oncoming >= 2 else 0.05))))
    d = spark.createDataFrame(rows, "scenario_id string, ego_maneuver string, n_oncoming_within_40m int, ego_speed_t0 double, y int").withColumn("split", store.split_of("scenario_id"))
    found = miner.mine(d, ["ego_maneuver", "n_oncoming_within_40m", "ego_speed_t0"], "y", depth=2).where("significant").orderBy("rank_wracc").collect()
    assert found[0]["rule"] == "ego_maneuver = left AND n_oncoming_within_40m >= 2"
    assert found[0]["conf_rate"] > 0.4 and found[0]["conf_lift"] > 4


def test_gate_verdicts(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.random() < 0.1), rng.gauss(0.9, 0.05)) for i in range(300)]
    base = spark.createDataFrame(rows, "scenario_id long, at_fault_collision double, progress_ratio double")
    worse = base.withColumn("progress_ratio", F.col("progress_ratio") - 0.1)
    same = {r["metric"]: r["verdict"] for r in gate(base, base, ["at_fault_collision", "progress_ratio"], seed=1, n_boot=500).collect()}
    moved = {r["metric"]: r["verdict"] for r in gate(base, worse, ["at_fault_collision", "progress_ratio"], seed=1, n_boot=500).collect()}
    assert same == {"at_fault_collision": "inconclusive", "progress_ratio": "inconclusive"}
    assert moved == {"at_fault_collision": "inconclusive", "progress_ratio": "regression"}


def test_gate_cells(spark):
    rng = random.Random(2)
    base = spark.createDataFrame([(i, rng.gauss(1, 0.2), None if i % 2 else 1.0) for i in range(200)], "scenario_id long, progress_ratio double, min_ttc double")
    moved = base.where("scenario_id >= 10").withColumn("progress_ratio", F.col("progress_ratio") + 0.05).unionByName(spark.createDataFrame([(999, 1.0, 1.0)], base.schema))
    scopes = spark.createDataFrame([("few", 1, 10), ("few", 1, 12), ("none", 2, -1), ("half", 3, 1)] + [("half", 3, i) for i in range(100)], "scope string, scope_index int, scenario_id long")
    with pytest.warns(UserWarning, match="10 scenarios are in the baseline only and 1 in the candidate"):
        got = run_gate(base, moved, ["progress_ratio", "min_ttc"], scopes=scopes, seed=3, n_boot=400, min_effect={"progress_ratio": 0.01}, statistics={"min_ttc": bootstrap.log_mean})
    assert got.n_paired == 190 and [r[0] for r in got.only_candidate.collect()] == [999] and got.only_baseline.count() == 10
    cells = {(r["scope"], r["metric"]): r for r in got.cells.collect()}
    assert len(cells) == 8 and cells["half", "progress_ratio"]["n_paired"] == 90
    assert cells["overall", "progress_ratio"]["verdict"] == "improvement" and "better by +0.05" in cells["overall", "progress_ratio"]["reason"]
    assert cells["none", "min_ttc"]["n_paired"] == 0 and cells["few", "progress_ratio"]["verdict"] == "inconclusive" and "not tested" in cells["few", "progress_ratio"]["reason"]
    assert cells["overall", "min_ttc"]["delta"] == 0 and "holds 0" in cells["overall", "min_ttc"]["reason"]
    summary = got.summary()
    assert summary["family_size"] == 4 and summary["expected_false_positives"] == 0.2 and summary["passed"]
    small = {r["metric"]: r["verdict"] for r in gate(base, moved, ["progress_ratio"], seed=3, n_boot=400, min_effect=0.5).collect()}
    assert small == {"progress_ratio": "inconclusive"}
    for bad in ({"metrics": ["ade"]}, {"metrics": ["collision"]}, {"candidate": base.where("scenario_id < 0"), "metrics": ["min_ttc"]}):
        with pytest.raises(ValueError):
            run_gate(**({"baseline": base, "candidate": moved, "seed": 1} | bad))
    assert set(DIRECTIONS) >= {"refine_us_p50", "refine_iters_mean", "refine_converged_frac", "hot_path_allocs"} and "ade" not in DIRECTIONS


def test_mode_effect(spark):
    rng = random.Random(4)
    rows = [("a", i, int(rng.random() < 0.1), int(rng.random() < 0.3)) for i in range(400)] + [("b", i, rng.random(), rng.random()) for i in range(50)]
    paired = spark.createDataFrame([(c, i, float(x), float(y)) for c, i, x, y in rows], "config_name string, scenario_id long, log_replay double, reactive double")
    got = {r["config_name"]: r for r in analysis.mode_effect(paired, seed=1, n_boot=500).collect()}
    a = got["a"]
    assert a["delta_lo"] < a["delta"] < a["delta_hi"] and a["ratio"] == pytest.approx(a["reactive"] / a["log_replay"]) and a["ratio_lo"] > 1
    assert a["log_replay_lo"] < a["log_replay"] < a["log_replay_hi"] and got["b"]["log_replay_lo"] is None
    with pytest.raises(ValueError):
        analysis.mode_effect(paired.limit(0), seed=1)


def test_head_on_time_to_collision(spark):
    schema = "scenario_id long, step int, x double, y double, heading double, vx double, vy double, length double, width double"
    ego = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 10.0, 0.0, 4.8, 2.0), (2, 0, 0.0, 0.0, 0.0, 10.0, 0.0, 4.8, 2.0)], schema)
    agents = spark.createDataFrame([(1, 0, 30.0, 0.0, 3.141592653589793, -10.0, 0.0, 4.8, 2.0), (2, 0, 0.0, 5.0, 0.0, 10.0, 0.0, 4.8, 2.0)], schema)
    got = {r["scenario_id"]: r["min_ttc"] for r in scene.time_to_collision(ego, agents, dt=0.1).collect()}
    assert abs(got[1] - 1.3) < 1e-9 and got[2] is None  # 25.2 m of gap at 20 m/s
    far = agents.withColumn("x", F.lit(63.0))  # 58.2 m of gap: met after 2.91 s, at the exact step's thirtieth try; the stored step is tried 29 times
    assert abs(scene.time_to_collision(ego, far, dt=0.1, radius=99.0).where("scenario_id = 1").first()["min_ttc"] - 3.0) < 1e-9
    assert scene.time_to_collision(ego, far, radius=99.0).where("scenario_id = 1").first()["min_ttc"] is None
    near = scene.time_to_collision(ego, agents).where("scenario_id = 1").first()["min_ttc"]
    assert near == 13 * scene.STEP


def test_scenarios_without_cycles(spark, sf_dir):
    c = scene_queries.cycle_table(spark, sf_dir).where("scenario_id < 3")
    wanted = spark.createDataFrame([("r1", 1), ("r1", -1)], "run_id string, scenario_id long")
    got = {r["scenario_id"]: r["status"] for r in cycles.scenario_metrics(c, wanted).collect()}
    assert got[-1] == "no_cycles"


def test_map_edges_and_dangling_references(spark, tmp_path):
    lane = lambda succ: {"lane_type": "VEHICLE", "is_intersection": False, "centerline": [{"x": 0, "y": 0}], "successors": succ, "predecessors": []}
    (tmp_path / "m.json").write_text(json.dumps({"lane_segments": {"1": lane([2, 9]), "2": lane([])}, "drivable_areas": {}}))
    edges, dropped = ingest.lane_edges(ingest.read_maps(spark, str(tmp_path)))
    assert [(r["src"], r["dst"], r["kind"]) for r in edges.collect()] == [(1, 2, "succ")]
    assert [(r["kind"], r["n_dropped"]) for r in dropped.collect()] == [("succ", 1)]


def test_typed_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("run_id,scenario_id,collision,ade\nr1,s1,1.0,0.5\nr1,s2,NA,nan\n")
    got = store.read_csv(spark, str(tmp_path / "m.csv"), spark.createDataFrame([], "run_id string, scenario_id string, collision int, ade double, fde double").schema)
    assert [tuple(r) for r in got.orderBy("scenario_id").collect()] == [("r1", "s1", 1, 0.5, None), ("r1", "s2", None, None, None)]


def test_lane_ranks(spark):
    """The heading decides among lanes within 0.25 m of the nearest match, wherever they lie; bike lanes are no lanes of the ego."""
    lane = lambda i, y, turn, kind="VEHICLE": (1, i, [(-10.0, y - 10 * turn), (10.0, y + 10 * turn)], kind)
    rows = [lane(1, 0.24, 0.3), lane(2, 0.26, 0.0), lane(3, 0.6, 0.0), lane(4, 0.0, 0.0, "BIKE")]
    ls = spark.createDataFrame(rows, "scenario_id long, lane_idx long, points array<struct<x: double, y: double>>, lane_type string")
    at = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0)], "scenario_id long, point_id long, x double, y double, heading double")
    ranks = lambda d: [r["lane_idx"] for r in d.orderBy("rank").collect()]
    assert ranks(lanes.lane_matches(at, ls, 4.0, 1.5, drivable=True)) == [2, 1, 3]
    assert ranks(lanes.lane_matches(at, ls, 4.0, 1.5)) == [4, 1, 2, 3]  # the bike lane is the nearest, and 2 lies over 0.25 m beyond it
    assert ranks(lanes.lane_matches(at, ls, 4.0, drivable=True)) == [1, 2, 3]
    assert abs(lanes.wrong_direction(at.withColumn("heading", F.lit(0.3)), ls).first()["heading_error"] - (0.3 - 0.2914567944778671)) < 1e-9


def test_ego_speeds_without_step_0(spark):
    rows = [(1, 3, 0.2), (1, 4, 6.0), (2, 0, 9.0), (2, 1, None), (3, 0, None)]
    got = {r["scenario_id"]: tuple(r)[1:] for r in scene.ego_speed_features(spark.createDataFrame(rows, "scenario_id long, step int, v double")).collect()}
    assert got == {1: (0.0, 3.1, 6.0, 1, "low"), 2: (9.0, 9.0, 9.0, 0, "mid"), 3: (0.0, 0.0, 0.0, 0, "stopped")}


def test_fisher_with_nulls_and_large_counts(spark):
    rows = [(1, 3, 10, 1, 10), (2, None, 10, 1, 10), (3, 3, 10, 1, 10), (4, 0, 5, 0, 0)]
    got = {r["i"]: r["p_value"] for r in stats.with_fisher(spark.createDataFrame(rows, "i int, k1 long, n1 long, k0 long, n0 long"), "k1", "n1", "k0", "n0").collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] is None and got[1] == got[3] and got[4] == 1.0
    draw = random.Random(1)
    for _ in range(300):
        n1, n0 = draw.randint(1, 40), draw.randint(1, 40)
        k1, k0 = draw.randint(0, n1), draw.randint(0, n0)
        want = sum(math.comb(n1, x) * math.comb(n0, k1 + k0 - x) for x in range(k1, min(n1, k1 + k0) + 1) if k1 + k0 - x <= n0) / math.comb(n1 + n0, k1 + k0)
        assert math.isclose(stats.fisher_greater(k1, n1, k0, n0), want, rel_tol=1e-9)
    began = time.time()
    assert 0 < stats.fisher_greater(251_000_000, 500_000_000, 250_900_000, 500_000_000) < 1 and time.time() - began < 5


def test_unknown_lane_types_are_counted(spark, tmp_path):
    lane = lambda kind: {"lane_type": kind, "centerline": [{"x": 0, "y": 0}]}
    (tmp_path / "m.json").write_text(json.dumps({"lane_segments": {"1": lane("vehicle"), "2": lane("TRAM"), "3": lane(None)}}))
    maps = ingest.read_maps(spark, str(tmp_path))
    assert [r["n_unknown"] for r in ingest.unknown_lanes(maps).collect()] == [2] and ingest.lane_rows(maps).count() == 1
    tracks = spark.createDataFrame([("1", "vehicle", 0, "miami", "x")], "track_id string, object_type string, timestep int, city string, novel string")
    tracks.write.parquet(str(tmp_path / "t"))
    assert ingest.read_tracks(spark, str(tmp_path / "t")).columns == ["track_id", "object_type", "timestep", "city"]
