"""Zeros that were rounded from small negative numbers, against DuckDB's: -0.0, which equals 0.0 but isn't written alike."""

from __future__ import annotations

import duckdb

from tarnspark.plans import route_queries
from tarnspark.plans.scene_queries import _rounded

from .test_bends import differing


def test_rounding(spark):
    values = [-1.8e-6, 1.8e-6, -0.0, 0.0, -6e-5, -5.00001e-5, 12.34567, None, float("inf"), float("nan")]
    got = _rounded(spark.createDataFrame(list(enumerate(values)), "i long, v double"), 4, signed=("v",)).orderBy("i").collect()
    assert [repr(r["v"]) for r in got] == [repr(duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0]) for v in values]


def test_logged_states(spark, tmp_path):
    """An ego that drives 1.2 m in its first step, which lasts a little over 0.1 s, and so brakes by 2e-6 m/s2 from 12 m/s."""
    events = [(0, x, k) for x, k in ((8.6, 4), (9.6, 4), (60.0, 5), (70.0, 8))]
    assert not differing(spark, tmp_path, "m6_logged_states", route_queries, events, [(1, 100.5 * i) for i in range(5)])
    con = duckdb.connect()
    for t in ("events", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(f"SELECT step, a_lon, jerk FROM ({route_queries.ORACLE_SQL['m6_logged_states']}) ORDER BY step").fetchall()
    got = route_queries.m6_logged_states(spark, str(tmp_path)).select("step", "a_lon", "jerk").orderBy("step").collect()
    assert repr(list(map(tuple, got))) == repr(want)
    assert "-0.0" in repr(want)
