"""What a report shows, as data: estimates of the metric suite, the runs it is about, and a scenario's headline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.stats import wilson

from .scene import CAPABILITIES

# Metrics of a report as (name, kind, group, the capability it needs); the last two tell likeness to a driver, not safety.
SUITE = (
    ("at_fault_collision", "rate", "Safety", None), ("collision", "rate", "Safety", None), ("drivable_area_violation", "rate", "Safety", "drivable_area"),
    ("wrong_direction", "rate", "Safety", "lane_connectivity"), ("min_ttc", "mean", "Safety", None), ("ttc_below_thresh_frac", "mean", "Safety", None),
    ("max_offroad_dist", "mean", "Safety", "drivable_area"), ("progress_ratio", "mean", "Progress and compliance", None), ("route_completion", "mean", "Progress and compliance", None),
    ("speeding_frac", "mean", "Progress and compliance", "speed_limits"), ("comfort_violation", "rate", "Comfort", None), ("max_abs_a_lon", "mean", "Comfort", None),
    ("max_abs_a_lat", "mean", "Comfort", None), ("max_abs_jerk", "mean", "Comfort", None), ("max_abs_yaw_rate", "mean", "Comfort", None),
    ("ade", "mean", "Similarity", None), ("fde", "mean", "Similarity", None),
)
# Normal quantile of a report's intervals; time to collision (s) that a headline names.
Z, SHORT_TTC = 1.959964, 1.5
NOT_MEASURABLE, NOT_MEASURED = "not measurable on this dataset", "not yet measured"


def metric_estimates(metrics: DataFrame, runs: DataFrame, suite: tuple = SUITE) -> DataFrame:
    """A row for each run and metric: run_id, metric, metric_group, n, k, value, lo, hi, measurable, reason.

    A rate is the share of values over one half with Wilson bounds, a mean has normal bounds (none for a single value); only finite values
    count. Where the run's capabilities lack what a metric needs, it is not measurable, whatever its column holds. A column that metrics lacks has not been
    measured."""
    d = metrics.join(F.broadcast(runs.select("run_id", "capabilities")), "run_id")
    parts = []
    for name, kind, group, needs in suite:
        v = F.col(name).cast("double") if name in metrics.columns else F.lit(None).cast("double")
        measurable = F.lit(True) if needs is None else F.col("capabilities").bitwiseAND(F.lit(CAPABILITIES[needs])) != 0
        v = F.when(measurable & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
        parts.append(F.struct(F.lit(name).alias("metric"), F.lit(group).alias("metric_group"), F.lit(kind).alias("kind"), measurable.alias("measurable"), F.lit(needs).cast("string").alias("needs"), v.alias("v")))
    d = d.select("run_id", F.explode(F.array(*parts)).alias("p")).select("run_id", "p.*")
    d = d.groupBy("run_id", "metric", "metric_group", "kind", "measurable", "needs").agg(F.count("v").alias("n"), F.count_if(F.col("v") > 0.5).alias("k"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    rate, low, high = F.try_divide("k", "n"), *wilson(F.col("k"), F.col("n"), 0.05)
    reach = F.when(F.col("n") > 1, Z * F.col("sd") / F.sqrt("n"))
    of = lambda a, b: F.when(F.col("kind") == "rate", a).otherwise(b)
    reason = F.when(~F.col("measurable"), F.concat(F.lit(f"{NOT_MEASURABLE}: no "), F.regexp_replace("needs", "_", " "))).when(F.col("n") == 0, NOT_MEASURED)
    return d.select("run_id", "metric", "metric_group", "n", F.when((F.col("kind") == "rate") & (F.col("n") > 0), F.col("k")).alias("k"), of(rate, F.col("mean")).alias("value"), of(low, F.col("mean") - reach).alias("lo"), of(high, F.col("mean") + reach).alias("hi"), "measurable", reason.alias("reason"))


def picked_runs(runs: DataFrame, job_run: str | None = None, gate_run: str | None = None) -> DataFrame:
    """The runs a report is about: role (primary, log_replay, reactive), run_id, mismatch.

    The primary run is that of the mining job, else the gate's candidate, else the newest reactive run, else the newest. For each agent mode it is the newest run of
    the primary's configuration and planner, else the newest of any, marked as a mismatch."""
    newest = [F.desc_nulls_last("created_at"), F.asc("run_id")]
    order = F.when(F.col("run_id") == F.lit(job_run), 0).when(F.col("run_id") == F.lit(gate_run), 1).when(F.col("agent_mode") == "reactive", 2).otherwise(3)
    primary = runs.orderBy(order, *newest).limit(1).select(F.col("run_id").alias("primary_id"), F.col("config_name").alias("primary_config"), F.col("planner").alias("primary_planner"))
    d = runs.where(F.col("agent_mode").isin("log_replay", "reactive")).join(F.broadcast(primary), F.lit(True))
    same = (F.col("config_name") == F.col("primary_config")) & F.col("planner").eqNullSafe(F.col("primary_planner"))
    best = F.min_by(F.struct("run_id", (~same).alias("mismatch")), F.struct((~same).alias("a"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("b"), F.col("run_id").alias("c")))
    modes = d.groupBy(F.col("agent_mode").alias("role")).agg(best.alias("m")).select("role", "m.run_id", "m.mismatch")
    return primary.select(F.lit("primary").alias("role"), F.col("primary_id").alias("run_id"), F.lit(False).alias("mismatch")).unionByName(modes)


def headline(c: Callable[[str], Column] = F.col) -> Column:
    """The gravest thing that can be said of a scenario, by the columns of metrics."""
    flag = lambda name: F.coalesce(c(name) == 1, F.lit(False))
    said = lambda text, *values: F.format_string(text, *[F.coalesce(c(v).cast("double"), F.lit(0.0)) for v in values])
    fault = F.when(c("collision_time").isNotNull(), said("at-fault collision at t = %.1f s", "collision_time")).otherwise("at-fault collision")
    out = F.when(flag("at_fault_collision"), fault).when(flag("collision"), "collision, not at fault")
    out = out.when(flag("drivable_area_violation"), said("off drivable area by %.2f m", "max_offroad_dist")).when(flag("wrong_direction"), "wrong-direction travel")
    out = out.when(c("min_ttc") < SHORT_TTC, said("min TTC %.2f s", "min_ttc")).when(flag("comfort_violation"), said("lateral acceleration %.2f m/s2", "max_abs_a_lat"))
    return out.when(c("ade").isNotNull(), said("ADE %.2f m (similarity, not correctness)", "ade")).otherwise("no metric flagged")


def latest(spark_table: DataFrame, by: str) -> DataFrame:
    """The newest row of a store's table; none of an empty one."""
    return spark_table.orderBy(F.desc_nulls_last(by)).limit(1)
