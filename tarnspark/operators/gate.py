"""The regression gate: paired bootstrap of scope x metric cells, corrected over the family, with a verdict and a reason each."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tarnspark.functions.stats import benjamini_hochberg, excludes

from .analysis import only_in_one, pair_coverage
from .bootstrap import Statistic, mean, paired_cluster_bootstrap

# 1 if more is better, -1 if less is. ade and fde have no direction on purpose.
DIRECTIONS = {
    "collision": -1, "at_fault_collision": -1, "drivable_area_violation": -1, "max_offroad_dist": -1, "wrong_direction": -1, "min_ttc": 1,
    "ttc_below_thresh_frac": -1, "progress_ratio": 1, "route_completion": 1, "speeding_frac": -1, "max_abs_a_lon": -1, "max_abs_a_lat": -1,
    "max_abs_jerk": -1, "max_abs_yaw_rate": -1, "comfort_violation": -1, "plan_us_p50": -1, "plan_us_p99": -1, "plan_us_mean": -1, "plan_us_max": -1,
    "refine_us_p50": -1, "refine_iters_mean": -1, "refine_converged_frac": 1, "hot_path_allocs": -1,
}
MIN_PAIRS = 3
#: The scope of all paired scenarios, and how far the seeds of two scopes lie apart.
OVERALL, SEED_STEP = "overall", 7919


@dataclass
class Gated:
    """cells: a row for each scope and metric; n_paired scenarios, and DataFrames of the scenario_ids that one run lacks."""

    cells: DataFrame
    n_paired: int
    only_baseline: DataFrame
    only_candidate: DataFrame
    alpha: float

    def summary(self) -> dict:
        """Sizes of the family and of each verdict; the family is the cells that were tested."""
        tested = F.col("p_value").isNotNull() & ~F.isnan("p_value")
        row = self.cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(tested).alias("family_size"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("regression", "improvement", "inconclusive")]).first().asDict()
        return row | {"expected_false_positives": self.alpha * row["family_size"], "passed": row["regression"] == 0, "n_paired": self.n_paired}


def run_gate(
    baseline: DataFrame, candidate: DataFrame, metrics: list[str], *, scopes: DataFrame | None = None, n_boot: int = 10_000, seed: int, alpha: float = 0.05,
    min_effect: float | dict[str, float] = 0.0, directions: dict[str, int] | None = None, statistics: dict[str, Statistic] | None = None, correction: str | None = "bh",
) -> Gated:
    """Compares two runs on the scenarios that both have. baseline and candidate: scenario_id and the metrics; scopes: (scope,
    scope_index from 1, scenario_id), as scopes_from_rules() gives them; all paired scenarios are the scope `overall`.

    Each cell has n_paired, baseline_val, candidate_val, delta with its interval, p_value, q_value, verdict (regression, improvement or
    inconclusive) and reason. Cells of fewer than MIN_PAIRS pairs are not tested and no part of the family. Each cell draws with a seed of its own.
    Raises for a metric without a direction or column, for runs that share no scenario, and for scopes of one name; warns of unpaired scenarios.
    """
    known = DIRECTIONS | (directions or {})
    unknown = [m for m in metrics if m not in known]
    if unknown:
        raise ValueError(f"no direction is declared for {', '.join(unknown)}")
    lacking = [m for m in metrics if m not in baseline.columns or m not in candidate.columns]
    if lacking:
        raise ValueError(f"a run lacks {', '.join(lacking)}")
    n_paired, n_a, n_b = pair_coverage(baseline, candidate).first()
    if not n_paired:
        raise ValueError("the runs share no scenario")
    only_a, only_b = only_in_one(baseline, candidate)
    if n_a or n_b:
        warnings.warn(f"{n_a} scenarios are in the baseline only and {n_b} in the candidate only; the {n_paired} paired ones are compared", stacklevel=2)

    spark = baseline.sparkSession
    named = [(OVERALL, 0)]
    if scopes is not None:
        named += sorted(((r["scope"], r["scope_index"]) for r in scopes.select("scope", "scope_index").distinct().collect()), key=lambda r: r[1])
        if len({s for s, _ in named}) < len(named):
            raise ValueError("two scopes have one name")
    cells = spark.createDataFrame([(s, m, seed + SEED_STEP * si + mi) for s, si in named for mi, m in enumerate(metrics)], "scope string, metric string, seed long")
    # Scenarios are joined as they are, and unfolded by scope and metric only then: what is shuffled does not grow with the number of metrics or scopes.
    side = lambda d, name: d.select("scenario_id", F.array(*[F.col(m).cast("double") for m in metrics]).alias(name))
    placed, inside = side(baseline, "a").join(side(candidate, "b"), "scenario_id"), F.array(F.lit(OVERALL))
    if scopes is not None:
        placed = placed.join(scopes.groupBy("scenario_id").agg(F.collect_set("scope").alias("inside")), "scenario_id", "left")
        inside = F.concat(inside, F.coalesce("inside", F.array().cast("array<string>")))
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("a")[i].alias("a"), F.col("b")[i].alias("b")) for i, m in enumerate(metrics)])
    placed = placed.select("scenario_id", F.explode(inside).alias("scope"), values.alias("values")).select("scenario_id", "scope", F.inline("values"))
    placed = placed.where(" AND ".join(f"{x} IS NOT NULL AND NOT isnan({x})" for x in "ab")).join(F.broadcast(cells), ["scope", "metric"])

    groups: dict[Statistic, list[str]] = {}
    for m in metrics:
        groups.setdefault((statistics or {}).get(m, mean), []).append(m)
    found = None
    for statistic, own in groups.items():
        part = paired_cluster_bootstrap(placed.where(F.col("metric").isin(own)), ["scope", "metric"], "scenario_id", "a", "b", seed=F.col("seed"), n_boot=n_boot, alpha=alpha, statistic=statistic)
        found = part if found is None else found.unionByName(part)
    enough = F.col("n_paired") >= MIN_PAIRS
    only = lambda c: F.when(enough, F.col(c)).otherwise(float("nan")).alias(c)
    found = cells.drop("seed").join(found, ["scope", "metric"], "left").select(
        "scope", "metric", F.coalesce("n_paired", F.lit(0)).cast("long").alias("n_paired"), F.col("first").alias("baseline_val"), F.col("second").alias("candidate_val"), "delta", "delta_lo", "delta_hi", "p_value"
    ).select("scope", "metric", "n_paired", "baseline_val", "candidate_val", *map(only, ("delta", "delta_lo", "delta_hi", "p_value")))
    tested = benjamini_hochberg(found, alpha=alpha).drop("rejected")
    of = lambda values, default: F.coalesce(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[F.col("metric")], F.lit(default))
    effect = of({m: float(min_effect.get(m, 0.0)) if isinstance(min_effect, dict) else float(min_effect) for m in metrics}, 0.0)
    moved = F.col("delta") * of({m: known[m] for m in metrics}, 1)
    decided = {
        "thin": ~enough, "open": ~excludes(F.col("delta_lo"), F.col("delta_hi"), 0.0),
        "chance": F.lit(correction == "bh") & ~F.coalesce(F.col("q_value") <= alpha, F.lit(False)), "small": F.abs("delta") < effect,
    }
    verdict, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    interval = F.format_string("%+.4g [%+.4g, %+.4g]", "delta", "delta_lo", "delta_hi")
    family = F.count_if(enough).over(_every())
    texts = {
        "thin": F.format_string(f"%d paired scenarios with both values, fewer than {MIN_PAIRS}: not tested", "n_paired"),
        "open": F.concat(interval, F.format_string(": the interval over %d pairs holds 0", "n_paired")),
        "chance": F.concat(interval, F.format_string(f": q = %.3g is not below {alpha} in a family of %d cells, of which %.1f would exclude 0 by chance", "q_value", family, family * alpha)),
        "small": F.concat(interval, F.format_string(": a difference, but below the least effect of %.4g", effect)),
    }
    for k, held in decided.items():
        verdict, reason = verdict.when(held, "inconclusive"), reason.when(held, texts[k])
    verdict = verdict.when(moved > 0, "improvement").otherwise("regression")
    reason = reason.otherwise(F.concat(F.when(moved > 0, "better by ").otherwise("worse by "), interval, F.format_string(" over %d pairs, q = %.3g in a family of %d cells", "n_paired", "q_value", family)))
    return Gated(tested.withColumn("verdict", verdict).withColumn("reason", reason), n_paired, only_a, only_b, alpha)


def _every() -> WindowSpec:
    """One window over all cells, of which there are as many as scopes times metrics."""
    return Window.partitionBy(F.lit(0))


def gate(baseline: DataFrame, candidate: DataFrame, metrics: list[str], **options) -> DataFrame:
    """run_gate()'s cells."""
    return run_gate(baseline, candidate, metrics, **options).cells
