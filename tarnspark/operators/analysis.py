"""The named analyses of the results store. Inputs: runs (run_id), metrics (run_id, scenario_id), features (scenario_id).

Scenarios whose status is not ok count in none of them but group_failure_rates and pair_coverage, which take what they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.quantiles import quantiles, with_few
from tarnspark.functions.stats import kendall_tau, wilson
from tarnspark.sources.work import kept

from . import bootstrap

#: Bounds of comfort (m/s2, m/s2, m/s3, rad/s) that the breakdown takes, by channel.
COMFORT = {"max_abs_a_lon": 2.40, "max_abs_a_lat": 4.89, "max_abs_jerk": 8.37, "max_abs_yaw_rate": 0.95}


def _ok(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("status") == "ok")


def group_failure_rates(metrics: DataFrame, features: DataFrame, run_id: str, target: str = "at_fault_collision", by: str = "ego_maneuver", alpha: float = 0.05) -> DataFrame:
    """Scenarios, failures and failure rate of one run by a feature, with Wilson bounds; NULL features are a group, NULL targets
    don't count."""
    d = metrics.where((F.col("run_id") == run_id) & F.col(target).isNotNull()).select("scenario_id", target).join(features.select("scenario_id", by), "scenario_id")
    d = d.groupBy(F.coalesce(by, F.lit("(null)")).alias(by)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"), alpha)
    return d.select(by, "n", "k", (F.col("k") / F.col("n")).alias("rate"), low.alias("rate_lo"), high.alias("rate_hi"))


def comfort_breakdown(metrics: DataFrame, run_id: str, bounds: dict[str, float] | None = None, alpha: float = 0.05) -> DataFrame:
    """Violations by channel, of any channel, and as stored, in one pass. A channel counts the scenarios in which it was measured."""
    bounds = bounds or COMFORT
    over = {c: F.col(c) > b for c, b in bounds.items()}
    anyone = F.greatest(*[F.coalesce(x.cast("int"), F.lit(0)) for x in over.values()])
    measured = F.coalesce(*[F.col(c) for c in bounds]).isNotNull()
    channels = {**{c: (F.col(c).isNotNull(), over[c].cast("int")) for c in bounds}, "any_channel": (measured, anyone), "stored_flag": (F.col("comfort_violation").isNotNull(), F.col("comfort_violation"))}
    sums = [x for c, (there, hit) in channels.items() for x in (F.sum(there.cast("long")).alias(f"{c}__n"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias(f"{c}__k"))]
    one = _ok(metrics).where(F.col("run_id") == run_id).agg(*sums)
    stack = ", ".join(f"'{c}', `{c}__n`, `{c}__k`" for c in channels)
    d = one.select(F.expr(f"stack({len(channels)}, {stack}) AS (channel, n, k)"))
    low, high = wilson(F.col("k"), F.col("n"), alpha)
    return d.select("channel", "n", "k", (F.col("k") / F.nullif("n", F.lit(0))).alias("rate"), low.alias("rate_lo"), high.alias("rate_hi"))


def comfort_consistency(metrics: DataFrame, run_id: str, bounds: dict[str, float] | None = None) -> DataFrame:
    """How many stored flags no measured channel explains, and how many violations are not flagged; unknown comparisons count for
    neither."""
    bounds = bounds or COMFORT
    over = None
    for c, b in bounds.items():
        over = (F.col(c) > b) if over is None else over | (F.col(c) > b)
    flagged = F.col("comfort_violation") == 1
    return _ok(metrics).where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("n"), F.sum((flagged & ~over).cast("long")).alias("n_flagged_without_violation"), F.sum((~flagged & over).cast("long")).alias("n_violation_without_flag"))


def latency_aggregates(metrics: DataFrame, runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """Planning latency of ok scenarios by hardware: medians, the 90th percentile, the mean weighted by cycles, the maximum. Raises if runs of
    more than one hardware would be blended."""
    chosen = runs.where(F.col("run_id").isin(run_ids))
    labels = [r[0] for r in chosen.select("hardware").distinct().limit(2).collect()]
    if len(labels) > 1:
        raise ValueError(f"runs of different hardware can't be blended: {sorted(map(str, labels))}")
    columns = ("n_cycles", "plan_us_p50", "plan_us_p99", "plan_us_mean", "plan_us_max")
    d = kept(_ok(metrics).join(F.broadcast(chosen.select("run_id", "hardware")), "run_id").where("n_cycles > 0").select("hardware", *columns), "latency")
    out = d.groupBy("hardware").agg(
        F.count(F.lit(1)).alias("n_scenarios"), F.sum("n_cycles").alias("n_cycles"),
        (F.sum(F.col("plan_us_mean") * F.col("n_cycles")) / F.nullif(F.sum("n_cycles"), F.lit(0))).alias("mean_weighted"), F.max("plan_us_max").alias("max_us"),
    )
    for q in (quantiles(d, ["hardware"], "plan_us_p50", {"p50_median": 0.5, "p50_p90": 0.9}), quantiles(d, ["hardware"], "plan_us_p99", {"p99_median": 0.5})):
        out = with_few(out, q, ["hardware"], "left")
    return out.select("hardware", "n_scenarios", "n_cycles", "p50_median", "p50_p90", "p99_median", "mean_weighted", "max_us")


def paired_by_mode(metrics: DataFrame, runs: DataFrame, metric: str, modes: tuple[str, str] = ("log_replay", "reactive"), *, dataset: str, planner: str) -> DataFrame:
    """A row for each configuration and scenario measured under both agent modes, of one dataset and planner."""
    runs = runs.where((F.col("dataset") == dataset) & (F.col("planner") == planner))
    d = _ok(metrics).where(F.col(metric).isNotNull()).join(F.broadcast(runs.select("run_id", "config_name", "agent_mode")), "run_id")
    value = lambda m: F.max(F.when(F.col("agent_mode") == m, F.col(metric)))
    d = d.groupBy("config_name", "scenario_id").agg(*[value(m).alias(m) for m in modes])
    return d.where(F.col(modes[0]).isNotNull() & F.col(modes[1]).isNotNull())


def mode_comparison(paired: DataFrame, modes: tuple[str, str] = ("log_replay", "reactive")) -> DataFrame:
    a, b = (F.col(m).cast("double") for m in modes)
    return paired.groupBy("config_name").agg(F.count(F.lit(1)).alias("n_paired"), F.avg(a).alias("mean_first"), F.avg(b).alias("mean_second"), F.avg(b - a).alias("delta"))


def mode_effect(paired: DataFrame, modes: tuple[str, str] = ("log_replay", "reactive"), *, seed: int, n_boot: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """The effect of the agent mode on each configuration's paired scenarios (paired_by_mode): means, delta and ratio of the second
    to the first, both with paired bootstrap intervals over scenarios, and each mode's Wilson bounds where all values are 0 or 1. The
    ratio's interval is that of the difference of logs. Raises if there is no pair."""
    if paired.isEmpty():
        raise ValueError("no scenario ran under both agent modes")
    options = {"seed": seed, "n_boot": n_boot, "alpha": alpha}
    delta = bootstrap.paired_cluster_bootstrap(paired, ["config_name"], "scenario_id", *modes, **options)
    logs = bootstrap.paired_cluster_bootstrap(paired, ["config_name"], "scenario_id", *modes, statistic=bootstrap.log_mean, **options)
    logs = logs.select("config_name", F.exp("delta").alias("ratio"), F.exp("delta_lo").alias("ratio_lo"), F.exp("delta_hi").alias("ratio_hi"))
    binary = F.min((F.col(modes[0]).isin(0, 1) & F.col(modes[1]).isin(0, 1)).cast("int")) == 1
    sums = paired.groupBy("config_name").agg(binary.alias("binary"), F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in modes])
    bounds = {f"{m}_{side}": F.when(F.col("binary"), c) for m in modes for side, c in zip(("lo", "hi"), wilson(F.col(m), F.col("n"), alpha, contain=True), strict=True)}
    sums = sums.select("config_name", *[c.alias(k) for k, c in bounds.items()])
    out = delta.select("config_name", "n_paired", F.col("first").alias(modes[0]), F.col("second").alias(modes[1]), "delta", "delta_lo", "delta_hi")
    return out.join(logs, "config_name").join(sums, "config_name")


def metric_disagreement(metrics: DataFrame, runs: DataFrame, agent_mode: str = "reactive", *, dataset: str) -> DataFrame:
    """Ranks of one dataset's configurations by similarity to the log (ade) and by safety, and the rank of their safety ranks' mean. Ranking a few
    configurations is one task."""
    d = _ok(metrics).join(F.broadcast(runs.where((F.col("agent_mode") == agent_mode) & (F.col("dataset") == dataset)).select("run_id", "config_name")), "run_id")
    means = d.groupBy("config_name").agg(F.avg("ade").alias("ade"), F.avg("collision").alias("collision"), F.avg("at_fault_collision").alias("at_fault"), F.avg("comfort_violation").alias("comfort"))
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last(c)))
    ranked = means.select("config_name", *[rank(c).alias(f"rank_{c}") for c in ("ade", "collision", "at_fault", "comfort")])
    ranked = ranked.withColumn("safety_rank_mean", (F.col("rank_collision") + F.col("rank_at_fault") + F.col("rank_comfort")) / 3)
    return ranked.withColumn("rank_safety", rank("safety_rank_mean"))


def rank_agreement(disagreement: DataFrame) -> dict:
    """Kendall's tau-b between the similarity and the safety ranking of metric_disagreement()'s configurations, its p-value and both
    winners. Raises for fewer than two configurations; they are few, one row each."""
    rows = disagreement.select("config_name", "rank_ade", "rank_safety").orderBy("config_name").collect()
    if len(rows) < 2:
        raise ValueError("two rankings need at least two configurations")
    tau, p = kendall_tau([r["rank_ade"] for r in rows], [r["rank_safety"] for r in rows])
    first = lambda c: min(rows, key=lambda r: r[c])["config_name"]
    return {"n_configs": len(rows), "kendall_tau": tau, "kendall_p": p, "ade_winner": first("rank_ade"), "safety_winner": first("rank_safety")}


def config_table(metrics: DataFrame, runs: DataFrame, flags: tuple[str, ...] = ("collision", "at_fault_collision", "drivable_area_violation", "wrong_direction")) -> DataFrame:
    """Scenarios and rates of the flags by configuration and agent mode; a flag that was never measured, or that metrics lacks, is NULL."""
    d = _ok(metrics).join(F.broadcast(runs.select("run_id", "config_name", "agent_mode")), "run_id")
    return d.groupBy("config_name", "agent_mode").agg(F.count(F.lit(1)).alias("n"), *[(F.avg(c) if c in metrics.columns else F.lit(None).cast("double")).alias(c) for c in flags])


def not_at_fault_rate(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Percent of scenarios with a collision that was not the ego's fault, by agent mode."""
    d = _ok(metrics).join(F.broadcast(runs.select("run_id", "agent_mode")), "run_id")
    return d.groupBy("agent_mode").agg((F.avg(F.col("collision") - F.col("at_fault_collision")) * 100).alias("not_at_fault_pct"))


def pair_coverage(baseline: DataFrame, candidate: DataFrame, key: str = "scenario_id") -> DataFrame:
    """How many keys two runs share, and how many only one of them has."""
    a, b = (d.select(key).distinct().withColumn(n, F.lit(1)) for d, n in ((baseline, "a"), (candidate, "b")))
    d = a.join(b, key, "full_outer")
    return d.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_paired"), F.count(F.when(F.col("b").isNull(), 1)).alias("n_only_baseline"), F.count(F.when(F.col("a").isNull(), 1)).alias("n_only_candidate"))


def only_in_one(baseline: DataFrame, candidate: DataFrame, key: str = "scenario_id") -> tuple[DataFrame, DataFrame]:
    """The keys that only the baseline has, and those that only the candidate has."""
    a, b = (d.select(key).distinct() for d in (baseline, candidate))
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")
