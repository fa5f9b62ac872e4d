"""Per-scenario metrics folded from planning cycles, one row a cycle, in one window and one aggregation over the same key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.geometry import distance

# Limits of the metric rules (s, share, m, rad).
TTC_BELOW, SPEEDING, OFFROAD, BACKWARDS, LEAST_PRIOR, LEAST_ARC = 0.95, 1.05, 0.3, math.pi / 2, 0.5, 0.5
# Comfort bounds of the verdict (m/s2, m/s2, m/s3, rad/s).
PEAKS = {"a_lon": 4.05, "a_lat": 4.89, "jerk": 8.37, "yaw_rate": 0.95}


def _flag(c: Column) -> Column:
    return c.cast("int")


def _share(hit: Column, of: Column) -> Column:
    """The share of rows with `of` that have `hit`; 0 where no row has it."""
    return F.coalesce(F.try_divide(F.sum(_flag(hit & of)), F.sum(_flag(of))), F.lit(0.0))


def scenario_metrics(cycles: DataFrame, scenarios: DataFrame | None = None) -> DataFrame:
    """(run_id, scenario_id, status and metrics). cycles: run_id, scenario_id, step, t, x, y, v, a_lon, a_lat, jerk, yaw_rate, s, path_length,
    speed_prior, offroad, heading_error, min_ttc, collision_agent, collision_agent_type, ego_struck_from_behind, log_x, log_y,
    plan_us, refine_converged. What was not measured is NULL, and stays NULL: offroad without an area, peaks of a replay,
    similarity without a log. Scenarios of `scenarios` without a cycle get the status no_cycles.
    """
    c, key = F.col, ["run_id", "scenario_id"]
    order = Window.partitionBy(*key).orderBy("step")
    d = cycles.withColumns({
        "__arc": distance(c("x"), c("y"), F.lag("x").over(order), F.lag("y").over(order)),
        "__log": distance(c("log_x"), c("log_y"), F.lag("log_x").over(order), F.lag("log_y").over(order)),
        "__off": distance(c("x"), c("y"), c("log_x"), c("log_y")),
    })
    hit = c("collision_agent").isNotNull()
    first = F.min(F.when(hit, F.struct("step", "t", "collision_agent_type", "ego_struck_from_behind")))
    folded = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_cycles"), first.alias("__first"),
        F.min("min_ttc").alias("min_ttc"), _share(c("min_ttc") < TTC_BELOW, c("min_ttc").isNotNull()).alias("ttc_below_thresh_frac"),
        _share(c("v") > SPEEDING * c("speed_prior"), F.coalesce(c("speed_prior") > LEAST_PRIOR, F.lit(False))).alias("speeding_frac"),
        F.max("offroad").alias("max_offroad_dist"), F.max(_flag(F.coalesce(F.abs("heading_error") > BACKWARDS, F.lit(False)))).alias("wrong_direction"),
        *[F.max(F.abs(k)).alias(f"max_abs_{k}") for k in PEAKS],
        F.avg("__off").alias("ade"), F.max_by("__off", F.when(c("__off").isNotNull(), c("step"))).alias("fde"),
        F.sum("__arc").alias("__arc"), F.sum("__log").alias("__log"), F.max_by("s", "step").alias("__s"), F.max("path_length").alias("__length"),
        F.percentile("plan_us", F.array(F.lit(0.5), F.lit(0.99))).alias("__us"), F.avg("plan_us").alias("plan_us_mean"), F.max("plan_us").alias("plan_us_max"),
        F.avg(_flag(c("refine_converged"))).alias("refine_converged_frac"),
    )
    over = [F.coalesce(c(f"max_abs_{k}") > b, F.lit(False)) for k, b in PEAKS.items()]
    measured = F.coalesce(*[c(f"max_abs_{k}") for k in PEAKS]).isNotNull()
    out = folded.select(
        *key, "n_cycles", _flag(c("__first").isNotNull()).alias("collision"),
        F.when(c("__first").isNotNull(), _flag(~c("__first.ego_struck_from_behind"))).otherwise(0).alias("at_fault_collision"),
        c("__first.t").alias("collision_time"), c("__first.collision_agent_type").alias("collision_agent_type"),
        "min_ttc", "ttc_below_thresh_frac", "speeding_frac", "max_offroad_dist", _flag(c("max_offroad_dist") > OFFROAD).alias("drivable_area_violation"), "wrong_direction",
        *[f"max_abs_{k}" for k in PEAKS], F.when(measured, _flag(over[0] | over[1] | over[2] | over[3])).alias("comfort_violation"),
        F.when(c("__log") > LEAST_ARC, c("__arc") / c("__log")).alias("progress_ratio"),
        F.when(c("__length") > LEAST_ARC, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("__s") / c("__length")))).alias("route_completion"),
        "ade", "fde", c("__us")[0].alias("plan_us_p50"), c("__us")[1].alias("plan_us_p99"), "plan_us_mean", "plan_us_max", "refine_converged_frac",
    )
    if scenarios is None:
        return out.withColumn("status", F.lit("ok"))
    return scenarios.select(*key).join(out, key, "left").withColumn("status", F.when(c("n_cycles").isNull(), "no_cycles").otherwise("ok"))


def kinematics(states: DataFrame, dt: float) -> DataFrame:
    """states (run_id, scenario_id, step, v, heading) with a_lon, yaw_rate, a_lat by backward differences and jerk by central
    differences of a_lon, one-sided at both ends; a single state has none."""
    w = Window.partitionBy("run_id", "scenario_id").orderBy("step")
    turn = F.col("heading") - F.lag("heading").over(w)
    turn = F.atan2(F.sin(turn), F.cos(turn))
    d = states.withColumn("a_lon", (F.col("v") - F.lag("v").over(w)) / dt).withColumn("yaw_rate", turn / dt)
    d = d.withColumn("a_lat", F.col("v") * F.col("yaw_rate"))
    before, after = F.lag("a_lon").over(w), F.lead("a_lon").over(w)
    jerk = F.coalesce((after - before) / (2 * dt), (after - F.col("a_lon")) / dt, (F.col("a_lon") - before) / dt)
    return d.withColumn("jerk", jerk)
