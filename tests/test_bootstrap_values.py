"""Draws by distinct values follow the law of draws by rows; medians are bootstrapped and gated."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.operators import bootstrap, gate


def test_distinct_values_do_the_work(spark):
    """A cell of a million flags is two rows, and its interval is that of the binomial law."""
    d = spark.range(1_000_000).select(F.lit("all").alias("cell"), F.col("id").alias("c"), (F.col("id") % 10 < 3).cast("double").alias("v"))
    units = d.groupBy("cell", "c").agg(F.sum("v").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    assert sorted(r["__times"] for r in bootstrap._distinct(units, ["cell"], F.lit(1), ["__sum", "__n"]).collect()) == [300_000, 700_000]
    r = bootstrap.cluster_bootstrap(d, ["cell"], "c", "v", seed=1, n_boot=2000).first()
    spread = 2 * 1.96 * np.sqrt(0.3 * 0.7 / 1e6)
    assert r["n_clusters"] == 1_000_000 and r["point"] == pytest.approx(0.3) and 0.9 < (r["ci_hi"] - r["ci_lo"]) / spread < 1.1 and r["ci_lo"] < 0.3 < r["ci_hi"]


def test_quantiles_of_weighted_values():
    draw = np.random.default_rng(2)
    values = np.sort(draw.normal(size=30).round(1))
    weights = draw.poisson(1.0, (30, 50)).astype(float)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = bootstrap.quantile(q).of(values, weights)
        assert got == pytest.approx([np.quantile(np.repeat(values, weights[:, i].astype(int)), q) for i in range(50)])
    assert np.isnan(bootstrap.median.of(values, np.zeros((30, 1)))).all()


def test_median_interval_against_brute_force(spark):
    draw = np.random.default_rng(5)
    a, b = draw.exponential(10, 400).round(2), draw.exponential(14, 400).round(2)
    d = spark.createDataFrame([("x", i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b, strict=True))] + [("y", 0, 1.0, 2.0), ("y", 1, None, 2.0)], "cell string, c long, a double, b double")
    got = {r["cell"]: r for r in bootstrap.paired_cluster_bootstrap(d, ["cell"], "c", "a", "b", seed=3, n_boot=2000, statistic=bootstrap.median).collect()}
    at = draw.integers(0, 400, (2000, 400))
    low, high = np.quantile(np.median(b[at], axis=1) - np.median(a[at], axis=1), [0.025, 0.975])
    x = got["x"]
    assert (x["n_clusters"], x["n_paired"]) == (400, 400) and x["first"] == pytest.approx(np.median(a)) and x["delta"] == pytest.approx(np.median(b) - np.median(a))
    width = high - low
    assert abs(x["delta_lo"] - low) < 0.2 * width and abs(x["delta_hi"] - high) < 0.2 * width and 0 < x["p_value"] < 0.5
    assert got["y"]["n_paired"] == 1 and np.isnan(got["y"]["delta_lo"])


def test_clusters_of_several_rows_share_a_weight(spark):
    """Forty clusters of fifty equal rows: the interval is that of forty values, not of two thousand."""
    rows = [("x", i, float(i), float(i) + 1) for i in range(40) for _ in range(50)]
    r = bootstrap.paired_cluster_bootstrap(spark.createDataFrame(rows, "cell string, c long, a double, b double"), ["cell"], "c", "a", "b", seed=1, n_boot=500, statistic=bootstrap.median).first()
    assert (r["n_clusters"], r["n_paired"], r["delta"], r["delta_lo"], r["delta_hi"]) == (40, 2000, 1, 1, 1)


def test_gate_of_a_median(spark):
    base = spark.range(300).select(F.col("id").alias("scenario_id"), (F.col("id") % 17).cast("double").alias("plan_us_p50"), (F.col("id") % 2).cast("double").alias("collision"))
    worse = base.withColumn("plan_us_p50", F.col("plan_us_p50") + 2 + F.col("scenario_id") % 3)
    got = {r["metric"]: r for r in gate.gate(base, worse, ["plan_us_p50", "collision"], seed=1, n_boot=400, statistics={"plan_us_p50": bootstrap.median}).collect()}
    assert got["plan_us_p50"]["verdict"] == "regression" and got["plan_us_p50"]["baseline_val"] == 8 and 1 <= got["plan_us_p50"]["delta_lo"] <= got["plan_us_p50"]["delta"] == 3
    assert got["collision"]["verdict"] == "inconclusive"
    plain = {r["metric"]: r for r in gate.gate(base, worse, ["plan_us_p50", "collision"], seed=1, n_boot=0, statistics={"plan_us_p50": bootstrap.median}).collect()}
    assert plain["plan_us_p50"]["delta"] == 3 and plain["plan_us_p50"]["p_value"] is None
