"""Cells and tracks of any size are dealt over tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tarnspark.operators import bootstrap, gate
from tarnspark.plans import queries


def test_no_cell_is_one_task(spark):
    d = spark.range(2000).select(F.lit("all").alias("cell"), F.col("id").alias("c"), (F.col("id") % 10).cast("double").alias("v"))
    out = bootstrap.cluster_bootstrap(d, ["cell"], "c", "v", seed=1, n_boot=400)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    r = out.first()
    assert (r["n_clusters"], r["n_rows"], r["point"]) == (2000, 2000, 4.5)
    assert 0.8 < (r["ci_hi"] - r["ci_lo"]) / (2 * 1.96 * np.sqrt(8.25 / 2000)) < 1.2
    base = d.select(F.col("c").alias("scenario_id"), F.col("v").alias("collision"))
    assert "FlatMapGroupsInPandas" not in gate.gate(base, base, ["collision"], seed=1, n_boot=100)._jdf.queryExecution().toString()


def test_far_boxes_do_not_meet(spark, tmp_path):
    rows = [(i, 1, 1000.0 * (i // 2)) for i in range(600)]
    d = spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts", "'{\"k\": 0}' AS props")
    d.write.parquet(str(tmp_path / "events.parquet"))
    out = queries.j14_box_overlaps(spark, str(tmp_path))
    assert tuple(out.first()) == (1, 600 * 599 // 2, 300)
    assert "cx" in out._jdf.queryExecution().optimizedPlan().toString()
