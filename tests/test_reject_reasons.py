"""Every event is judged, in as many scenarios as the table gives; of repeated states the last one counts."""

from __future__ import annotations

from tarnspark.plans import scene_queries


def test_scenarios_grow_with_the_table(spark, tmp_path):
    minute = "CAST(pmod(id, 40) AS int)"  # minutes 0 to 29, and ten repeats of minute 0
    d = spark.range(240 * 40).selectExpr("id AS event_id", "id DIV 40 AS user_id", f"timestamp_seconds(60 * IF({minute} < 30, {minute}, 0)) AS ts", "'click' AS event_type", "IF(pmod(id, 40) = 39, 100.0D, 1.0D) AS value", "'{\"k\": 1}' AS props")
    d.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["reason"]: r["n"] for r in scene_queries.i19_reject_reasons(spark, str(tmp_path)).collect()}
    assert got == {None: 240}  # the last state of minute 0 is 99 away from the rest, so all scenarios travel
