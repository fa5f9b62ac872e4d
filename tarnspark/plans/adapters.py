"""The results store laid over the driver's tables: runs, metrics (run, scenario) and features (scenario)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Scenarios whose least price is below this stand for failures of the planner.
FAILED_BELOW = 1200.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run; one for each return flag and line status."""
    d = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    mode = F.when(F.col("l_linestatus") == "O", "log_replay").otherwise("reactive")
    return d.select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("run_id"), F.col("l_returnflag").alias("config_name"), mode.alias("agent_mode"), F.lit("ilqr").alias("planner"), F.lit("driver").alias("dataset"), F.lit("box").alias("hardware"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run and scenario (order); longitudinal peaks of scenarios of one cycle can't be measured and are NULL."""
    flag = lambda c: c.cast("int")
    d = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_orderkey").alias("scenario_id")).agg(
        F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), F.max("l_extendedprice").alias("p"),
        F.count(F.lit(1)).alias("n_cycles"), F.round(F.avg("l_quantity"), 6).alias("ade"), F.min("l_extendedprice").alias("low"),
    )
    out = d.select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("run_id"), "scenario_id", F.when(F.col("low") < FAILED_BELOW, "planner_fail").otherwise("ok").alias("status"), "n_cycles", "ade",
        flag(F.col("d") >= 0.07).alias("collision"), flag(F.col("d") >= 0.09).alias("at_fault_collision"),
        flag(F.col("t") >= 0.08).alias("drivable_area_violation"), F.when(F.col("n_cycles") > 1, flag(F.col("t") < 0.03)).alias("wrong_direction"),
        F.when(F.col("n_cycles") > 1, F.col("q") / 10).alias("max_abs_a_lon"), (F.col("t") * 70).alias("max_abs_a_lat"),
        (F.col("p") / 10000).alias("max_abs_jerk"), (F.col("d") * 10).alias("max_abs_yaw_rate"),
        (F.col("low") / 50).alias("plan_us_p50"), (F.col("p") / 50).alias("plan_us_p99"), (F.col("low") / 40).alias("plan_us_mean"), (F.col("p") / 40).alias("plan_us_max"),
    )
    worst = (F.col("max_abs_a_lon") > 4.05) | (F.col("max_abs_a_lat") > 4.89) | (F.col("max_abs_jerk") > 8.37) | (F.col("max_abs_yaw_rate") > 0.95)
    return out.withColumn("comfort_violation", flag(F.coalesce(worst, F.lit(False))))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a scenario: what is known of it before any run."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    maneuver = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    return d.select(F.col("o_orderkey").alias("scenario_id"), maneuver.alias("ego_maneuver"), F.col("o_orderpriority").alias("city"), F.col("o_totalprice").alias("route_len_m"), F.col("c_acctbal").alias("ego_speed_t0"))


#: The same in DuckDB's SQL, as common table expressions; metrics has the scenarios of status ok only.
STORE_SQL = """
runs AS (
  SELECT DISTINCT l_returnflag || '_' || l_linestatus AS run_id, l_returnflag AS config_name,
    CASE WHEN l_linestatus = 'O' THEN 'log_replay' ELSE 'reactive' END AS agent_mode, 'box' AS hardware FROM lineitem
), grouped AS (
  SELECT l_returnflag || '_' || l_linestatus AS run_id, l_orderkey AS scenario_id, max(l_discount) AS d, max(l_quantity) AS q, max(l_tax) AS t,
    max(l_extendedprice) AS p, min(l_extendedprice) AS low, count(*) AS n_cycles, round(avg(l_quantity), 6) AS ade
  FROM lineitem GROUP BY ALL
), measured AS (
  SELECT run_id, scenario_id, CASE WHEN low < 1200.0 THEN 'planner_fail' ELSE 'ok' END AS status, n_cycles, ade, (d >= 0.07)::INT AS collision, (d >= 0.09)::INT AS at_fault_collision,
    (t >= 0.08)::INT AS drivable_area_violation, CASE WHEN n_cycles > 1 THEN (t < 0.03)::INT END AS wrong_direction,
    CASE WHEN n_cycles > 1 THEN q / 10 END AS max_abs_a_lon, t * 70 AS max_abs_a_lat, p / 10000 AS max_abs_jerk, d * 10 AS max_abs_yaw_rate,
    low / 50 AS plan_us_p50, p / 50 AS plan_us_p99, low / 40 AS plan_us_mean, p / 40 AS plan_us_max FROM grouped
), all_metrics AS (
  SELECT *, coalesce(max_abs_a_lon > 4.05 OR max_abs_a_lat > 4.89 OR max_abs_jerk > 8.37 OR max_abs_yaw_rate > 0.95, FALSE)::INT AS comfort_violation FROM measured
), metrics AS (
  SELECT * FROM all_metrics WHERE status = 'ok'
), features AS (
  SELECT o_orderkey AS scenario_id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS ego_maneuver, o_orderpriority AS city,
    o_totalprice AS route_len_m, c_acctbal AS ego_speed_t0 FROM orders JOIN customer ON o_custkey = c_custkey
)"""
