"""Analyses count scenarios of status ok only, and pair runs of one dataset and planner."""

from __future__ import annotations

import pytest

from tarnspark.operators import analysis

RUNS = [("a", "base", "log_replay", "p", "d", "box"), ("b", "base", "reactive", "p", "d", "box"), ("c", "base", "reactive", "q", "d", "box"), ("e", "base", "reactive", "p", "other", "box")]
PEAKS = ("max_abs_a_lon", "max_abs_a_lat", "max_abs_jerk", "max_abs_yaw_rate")


@pytest.fixture(scope="module")
def store(spark):
    rows = [(run, i, status, 10, 1.0, hit, hit, *[9.0 * hit] * 4, 1.0, 1.0, 1.0, 1.0, hit) for run in "ab" for i, status, hit in ((1, "ok", 0), (2, "ok", 0), (3, "planner_fail", 1), (4, "load_fail", 1))]
    rows += [(run, 1, "ok", 10, 1.0, 1, 1, *[9.0] * 4, 9.0, 9.0, 9.0, 9.0, 1) for run in "ce"]
    names = "run_id string, scenario_id long, status string, n_cycles long, ade double, collision int, at_fault_collision int, " + ", ".join(f"{p} double" for p in PEAKS)
    metrics = spark.createDataFrame(rows, names + ", plan_us_p50 double, plan_us_p99 double, plan_us_mean double, plan_us_max double, comfort_violation int")
    return metrics, spark.createDataFrame(RUNS, "run_id string, config_name string, agent_mode string, planner string, dataset string, hardware string")


def test_failed_scenarios_do_not_count(store):
    metrics, runs = store
    runs = runs.where("run_id IN ('a', 'b')")
    assert {(r["n"], r["k"]) for r in analysis.comfort_breakdown(metrics, "a").collect()} == {(2, 0)}
    assert analysis.comfort_consistency(metrics, "a").first()["n"] == 2
    assert analysis.latency_aggregates(metrics, runs, ["a", "b"]).first()["n_scenarios"] == 4
    assert {(r["n"], r["collision"]) for r in analysis.config_table(metrics, runs).collect()} == {(2, 0.0)}
    assert {r["not_at_fault_pct"] for r in analysis.not_at_fault_rate(metrics.replace(1, 0, ["at_fault_collision"]), runs).collect()} == {0.0}


def test_pairs_are_of_one_dataset_and_planner(store):
    paired = analysis.paired_by_mode(*store, "at_fault_collision", dataset="d", planner="p")
    assert sorted(map(tuple, paired.collect())) == [("base", 1, 0, 0), ("base", 2, 0, 0)]
    assert tuple(analysis.mode_comparison(paired).first()) == ("base", 2, 0.0, 0.0, 0.0)


def test_ranks_leave_failed_scenarios_out(spark, store):
    metrics, _ = store
    more = metrics.where("run_id = 'c'").replace("c", "f")
    runs = spark.createDataFrame([("b", "x", "reactive", "d"), ("f", "y", "reactive", "d"), ("e", "z", "reactive", "other")], "run_id string, config_name string, agent_mode string, dataset string")
    more = more.replace(1, 0, ["collision", "at_fault_collision", "comfort_violation"])
    got = {r["config_name"]: r["rank_collision"] for r in analysis.metric_disagreement(metrics.unionByName(more), runs, dataset="d").collect()}
    assert got == {"x": 1, "y": 1}
