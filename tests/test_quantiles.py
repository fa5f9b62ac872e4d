"""Exact quantiles by ranges, and the queries' operators that take them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.functions.quantiles import quantiles
from tarnspark.operators import analysis, bootstrap


def test_quantiles_of_groups(spark):
    draw = random.Random(3)
    made = {"a": [round(draw.expovariate(0.01), 1) for _ in range(3000)], None: [draw.choice((1.0, 2.0)) for _ in range(40)], "one": [7.5], "two": [1.0, 4.0]}
    rows = [(k, v) for k, vs in made.items() for v in vs] + [("a", None), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r for r in quantiles(d, ["k"], "v", {"low": 0.0, "half": 0.5, "p90": 0.9, "high": 1.0}).collect()}
    assert set(got) == set(made)
    for k, vs in made.items():
        assert tuple(got[k])[1:] == pytest.approx(tuple(np.quantile(vs, (0.0, 0.5, 0.9, 1.0))))


def test_no_task_holds_a_group(spark):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    metrics = spark.range(500).select(F.lit("r").alias("run_id"), F.col("id").alias("scenario_id"), F.lit("ok").alias("status"), F.lit(2).alias("n_cycles"), *[(F.col("id") * 1.5).alias(f"plan_us_{a}") for a in ("p50", "p99", "mean", "max")])
    runs = spark.createDataFrame([("r", None)], "run_id string, hardware string")
    found = analysis.latency_aggregates(metrics, runs, ["r"])
    assert "percentile" not in plan(found)
    assert tuple(found.first()) == pytest.approx((None, 500, 1000, 374.25, 673.65, 374.25, 374.25, 748.5))
    pairs = spark.range(500).select(F.lit("c").alias("cell"), (F.col("id") / 2).cast("long").alias("cluster"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    found = bootstrap.paired_cluster_bootstrap(pairs, ["cell"], "cluster", "a", "b", seed=1, n_boot=0, statistic=bootstrap.quantile(0.9))
    assert "InPandas" not in plan(found)
    assert tuple(found.first())[:6] == pytest.approx(("c", 250, 500, 449.1, 898.2, 449.1)) and found.columns[6:] == ["delta_lo", "delta_hi", "p_value"]
