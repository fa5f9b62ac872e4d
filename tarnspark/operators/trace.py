"""What a planner chose at each cycle and why, from the candidates that were stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Totals that differ by less than half a unit of this decimal place are equal.
SAME = 9


def weighted(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """candidates (terms: map of cost terms) with costs, the terms times their weights (1 if none is named), and total."""
    named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")
    costs = F.transform_values("terms", lambda k, v: v * F.coalesce(named[k], F.lit(1.0)))
    total = F.aggregate(F.map_values("costs"), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return candidates.withColumn("costs", costs).withColumn("total", total)


def cycle_trace(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(scenario_id, step, n_candidates, n_feasible, chosen, feasible, target_v, target_d, total, costs) of every cycle: a feasible candidate before any other, then the
    cheapest, then the first. candidates: scenario_id, step, candidate, feasible, target_v, target_d, terms. A candidate whose terms are NULL costs nothing."""
    d = weighted(candidates.withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string,double>"))), weights)
    best = F.min_by(F.struct("candidate", "feasible", "target_v", "target_d", "total", "costs"), F.struct((~F.col("feasible")).alias("no"), F.round("total", SAME).alias("total"), "candidate"))
    out = d.groupBy("scenario_id", "step").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("feasible").alias("n_feasible"), best.alias("b"))
    return out.select("scenario_id", "step", "n_candidates", "n_feasible", F.col("b.candidate").alias("chosen"), "b.feasible", "b.target_v", "b.target_d", "b.total", "b.costs")


def trace_terms(trace: DataFrame) -> DataFrame:
    """A row a cycle and cost term, with the term's share of the total (NULL where that is 0)."""
    d = trace.select("scenario_id", "step", "chosen", "total", F.explode("costs").alias("term", "cost"))
    return d.withColumn("share", F.try_divide("cost", "total"))
