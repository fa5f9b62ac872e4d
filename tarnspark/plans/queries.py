"""Queries of the evaluation store over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnspark.functions import geometry, stats
from tarnspark.operators import analysis, bootstrap, gate, predicates
from tarnspark.plans import adapters
from tarnspark.sources import store

RUN = "A_F"
DATASET, PLANNER = "driver", "ilqr"
#: Boxes of 40 by 16 whose centres are further apart don't touch.
REACH = 44.0
_Z = repr(stats.normal_quantile(0.975))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


def _metrics(s: SparkSession, d: str, run: str | None = None) -> DataFrame:
    m = adapters.metrics(s, d)
    return m.where(F.col("run_id") == run) if run else m


def a5_group_rate_wilson(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.group_failure_rates(_metrics(s, d), adapters.features(s, d), RUN))


def a6_comfort_breakdown(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.comfort_breakdown(_metrics(s, d), RUN))


def a7_comfort_consistency(s: SparkSession, d: str) -> DataFrame:
    return analysis.comfort_consistency(_metrics(s, d), RUN)


def a8_latency(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.latency_aggregates(_metrics(s, d), adapters.runs(s, d), ["A_F", "R_F"]), 4)


def a9_config_table(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.config_table(_metrics(s, d), adapters.runs(s, d)))


def a10_not_at_fault(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.not_at_fault_rate(_metrics(s, d), adapters.runs(s, d)))


def j5_paired_modes(s: SparkSession, d: str) -> DataFrame:
    return analysis.paired_by_mode(_metrics(s, d), adapters.runs(s, d), "at_fault_collision", dataset=DATASET, planner=PLANNER)


def t9_mode_deltas(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.mode_comparison(analysis.paired_by_mode(_metrics(s, d), adapters.runs(s, d), "at_fault_collision", dataset=DATASET, planner=PLANNER)))


def j6_pair_coverage(s: SparkSession, d: str) -> DataFrame:
    return analysis.pair_coverage(_metrics(s, d, "A_F"), _metrics(s, d, "R_F"))


def w1_metric_disagreement(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analysis.metric_disagreement(_metrics(s, d), adapters.runs(s, d), dataset=DATASET))


def _city_counts(s: SparkSession, d: str) -> DataFrame:
    m = _metrics(s, d, RUN).join(adapters.features(s, d).select("scenario_id", "city"), "scenario_id")
    g = m.groupBy("city").agg(F.count(F.lit(1)).alias("n1"), F.sum("at_fault_collision").cast("long").alias("k1"))
    every = g.agg(F.sum("n1").alias("n"), F.sum("k1").alias("k"))
    return g.crossJoin(F.broadcast(every)).select("city", "k1", "n1", (F.col("k") - F.col("k1")).alias("k0"), (F.col("n") - F.col("n1")).alias("n0"))


def w2_fisher_bh(s: SparkSession, d: str) -> DataFrame:
    """Each city's at-fault rate against all others', exact one-sided tests, corrected."""
    g = _city_counts(s, d)
    return _rounded(stats.benjamini_hochberg(stats.with_fisher(g, "k1", "n1", "k0", "n0")).select("city", "k1", "n1", "k0", "n0", "p_value", "q_value", "rejected"), 5)


def i6_duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return store.duplicate_keys(adapters.load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], None)


def i7_orphan_scenarios(s: SparkSession, d: str) -> DataFrame:
    """Orders without any line, by status (left anti join)."""
    o = adapters.load(s, d, "orders").select("o_orderkey", "o_orderstatus")
    lines = adapters.load(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(lines, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def i11_frozen_split(s: SparkSession, d: str) -> DataFrame:
    f = adapters.features(s, d).select("scenario_id")
    return store.split_counts(f.withColumn("split", store.split_of(F.concat(F.lit("scn-"), F.col("scenario_id").cast("string")))))


def p6_rule_counts(s: SparkSession, d: str) -> DataFrame:
    x = _metrics(s, d, RUN).join(adapters.features(s, d), "scenario_id")
    p = predicates.Predicate
    rules = [(p("ego_maneuver", "IS NULL"),), (p("ego_speed_t0", ">=", 5000.0), p("city", "=", "1-URGENT")), (p("route_len_m", "<", 100000.0),), (p("max_abs_a_lon", "IS NOT NULL"),)]
    return _rounded(predicates.rule_counts(x, rules, "at_fault_collision"))


GATED = ["at_fault_collision", "comfort_violation", "plan_us_p50"]


def _gated(s: SparkSession, d: str, **options) -> DataFrame:
    scopes = predicates.scopes_from_rules(adapters.features(s, d), [(predicates.Predicate("city", "=", "1-URGENT"),), (predicates.Predicate("route_len_m", "<", 0.0),)])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # most scenarios are in one run only
        return gate.gate(_metrics(s, d, "A_F"), _metrics(s, d, "R_F"), GATED, scopes=scopes, seed=20260917, **({"n_boot": 2000} | options))


def t13_gate(s: SparkSession, d: str) -> DataFrame:
    """The gate's cells, intervals and verdicts, drawn at random but for a seed."""
    return _gated(s, d)


def t13_gate_values(s: SparkSession, d: str) -> DataFrame:
    """What the gate's cells are of, without draws."""
    return _rounded(_gated(s, d, n_boot=0).select("scope", "metric", "n_paired", "baseline_val", "candidate_val", F.nanvl("delta", F.lit(None).cast("double")).alias("delta")))


def t13_median_values(s: SparkSession, d: str) -> DataFrame:
    """The gate's values where latency is judged by its median and its 90th percentile, not its mean."""
    of = lambda q: _gated(s, d, n_boot=0, statistics={"plan_us_p50": q}).where("metric = 'plan_us_p50'")
    both = of(bootstrap.median).withColumn("statistic", F.lit("median")).unionByName(of(bootstrap.quantile(0.9)).withColumn("statistic", F.lit("p90")))
    return _rounded(both.select("scope", "statistic", "n_paired", "baseline_val", "candidate_val", F.nanvl("delta", F.lit(None).cast("double")).alias("delta")))


def t9_mode_effect(s: SparkSession, d: str) -> DataFrame:
    paired = analysis.paired_by_mode(_metrics(s, d), adapters.runs(s, d), "at_fault_collision", dataset=DATASET, planner=PLANNER)
    return analysis.mode_effect(paired, seed=5, n_boot=2000)


def t5_rate_ratio(s: SparkSession, d: str) -> DataFrame:
    """Each city's at-fault rate against all others' by the log-scale interval."""
    g = _city_counts(s, d)
    out = stats.with_rate_ratio(g, "k1", "n1", "k0", "n0", F.lit(0), method="delta")
    return _rounded(out.select("city", "k1", "n1", F.col("ratio.point").alias("ratio"), F.col("ratio.lo").alias("ratio_lo"), F.col("ratio.hi").alias("ratio_hi"), "ratio.method"), 5)


def _tracks(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return adapters.load(s, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("x"), k.alias("y"))


def w4_arc_length(s: SparkSession, d: str) -> DataFrame:
    """Arc length of each track and its last step, by windows over consecutive states."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = geometry.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    t = _tracks(s, d).withColumn("step", F.coalesce(step, F.lit(0.0)))
    return _rounded(t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("arc"), F.max("step").alias("longest")))


def a12_speed_percentile(s: SparkSession, d: str) -> DataFrame:
    """The 85th percentile of a class's values within bounds, or a default where samples are few."""
    g = adapters.load(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.85)).alias("p"))
    return _rounded(g.select("event_type", "n", F.when(F.col("n") >= 5, F.greatest(F.lit(2.0), F.least(F.lit(22.0), F.col("p")))).otherwise(13.4).alias("prior")))


def j14_box_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes of one track and day that touch, by oriented boxes with the heading k pi / 50. Boxes meet those of
    their own and neighbouring cells only; all pairs are counted without being made."""
    t = _tracks(s, d).withColumn("day", F.to_date("ts")).withColumn("h", F.col("y") * F.pi() / 50)
    a, b = (t.select("user_id", "day", *[F.col(c).alias(f"{c}_{n}") for c in ("event_id", "x", "y", "h")]) for n in "ab")
    cell = lambda c: F.floor(F.col(c) / REACH)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    a = a.withColumns({"cx": cell("x_a"), "cy": cell("y_a")})
    b = b.withColumn("i", near).withColumn("j", near).withColumns({"cx": cell("x_b") + F.col("i"), "cy": cell("y_b") + F.col("j")})
    c = F.col
    hit = geometry.box_overlap(c("x_a"), c("y_a"), c("h_a"), F.lit(40.0), F.lit(16.0), c("x_b"), c("y_b"), c("h_b"), F.lit(40.0), F.lit(16.0))
    hits = a.join(b, ["user_id", "day", "cx", "cy"]).where("event_id_a < event_id_b").where(hit).groupBy("user_id").agg(F.count(F.lit(1)).alias("overlaps"))
    same = t.where("user_id IS NOT NULL AND day IS NOT NULL AND event_id IS NOT NULL").groupBy("user_id", "day", "event_id").agg(F.count(F.lit(1)).alias("m"))
    pairs = same.groupBy("user_id", "day").agg(F.sum("m").alias("n"), F.sum(c("m") * c("m")).alias("own"))
    pairs = pairs.groupBy("user_id").agg(F.sum(F.expr("(n * n - own) DIV 2")).alias("pairs")).where("pairs > 0")
    return pairs.join(hits, "user_id", "left").select("user_id", "pairs", F.coalesce("overlaps", F.lit(0).cast("long")).alias("overlaps"))


def touch_sql(half_length: float, half_width: float) -> str:
    """DuckDB's SQL for: no axis separates the boxes e and o, whose centres lie dx and dy apart."""

    def apart(ux: str, uy: str) -> str:
        reach = " + ".join(f"abs(cos({h}) * ({ux}) + sin({h}) * ({uy})) * {half_length} + abs(cos({h}) * ({uy}) - sin({h}) * ({ux})) * {half_width}" for h in ("e.heading", "o.heading"))
        return f"abs(dx * ({ux}) + dy * ({uy})) > {reach}"

    return " AND ".join(f"NOT ({apart(x, y)})" for h in ("e.heading", "o.heading") for x, y in ((f"cos({h})", f"sin({h})"), (f"-sin({h})", f"cos({h})")))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "aijptw" and k[1:2].isdigit()}

_WILSON = f"""greatest(0.0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n))"""
_WILSON_LO, _WILSON_HI = f"round({_WILSON}, 6) AS rate_lo", f"round({_WILSON.replace('greatest(0.0', 'least(1.0').replace(f' - {_Z} * sqrt', f' + {_Z} * sqrt')}, 6) AS rate_hi"
_OVER = "max_abs_a_lon > 2.40 OR max_abs_a_lat > 4.89 OR max_abs_jerk > 8.37 OR max_abs_yaw_rate > 0.95"
_CHANNELS = " UNION ALL ".join(
    [f"SELECT '{c}' AS channel, count({c}) AS n, coalesce(sum(({c} > {b})::INT), 0)::BIGINT AS k FROM m" for c, b in analysis.COMFORT.items()]
    + [f"SELECT 'any_channel', count(*), sum(coalesce({_OVER}, FALSE)::INT)::BIGINT FROM m", "SELECT 'stored_flag', count(comfort_violation), sum(comfort_violation)::BIGINT FROM m"]
)
_STORE = f"WITH {adapters.STORE_SQL}"
_RULES = [("ego_maneuver IS NULL", "ego_maneuver IS NULL"), ("city = 1-URGENT AND ego_speed_t0 >= 5000", "city = '1-URGENT' AND ego_speed_t0 >= 5000"), ("route_len_m < 100000", "route_len_m < 100000"), ("max_abs_a_lon IS NOT NULL", "max_abs_a_lon IS NOT NULL")]

ORACLE_SQL = {
    "a5_group_rate_wilson": f"""{_STORE}, g AS (
  SELECT coalesce(ego_maneuver, '(null)') AS ego_maneuver, count(*) AS n, sum(at_fault_collision)::BIGINT AS k FROM all_metrics JOIN features USING (scenario_id) WHERE run_id = '{RUN}' GROUP BY 1
), r AS (SELECT *, k / n AS p FROM g) SELECT ego_maneuver, n, k, round(p, 6) AS rate, {_WILSON_LO}, {_WILSON_HI} FROM r""",
    "a6_comfort_breakdown": f"""{_STORE}, m AS (SELECT * FROM metrics WHERE run_id = '{RUN}'), c AS ({_CHANNELS}), r AS (SELECT *, k / n AS p FROM c)
SELECT channel, n, k, round(p, 6) AS rate, {_WILSON_LO}, {_WILSON_HI} FROM r""",
    "a7_comfort_consistency": f"""{_STORE} SELECT count(*) AS n, sum((comfort_violation = 1 AND NOT ({_OVER}))::INT)::BIGINT AS n_flagged_without_violation,
  sum((comfort_violation <> 1 AND ({_OVER}))::INT)::BIGINT AS n_violation_without_flag FROM metrics WHERE run_id = '{RUN}'""",
    "a8_latency": f"""{_STORE} SELECT hardware, count(*) AS n_scenarios, sum(n_cycles)::BIGINT AS n_cycles, round(quantile_cont(plan_us_p50, 0.5), 4) AS p50_median, round(quantile_cont(plan_us_p50, 0.9), 4) AS p50_p90,
  round(quantile_cont(plan_us_p99, 0.5), 4) AS p99_median, round(sum(plan_us_mean * n_cycles) / sum(n_cycles), 4) AS mean_weighted, round(max(plan_us_max), 4) AS max_us
FROM metrics JOIN runs USING (run_id) WHERE run_id IN ('A_F', 'R_F') AND n_cycles > 0 GROUP BY hardware""",
    "a9_config_table": f"""{_STORE} SELECT config_name, agent_mode, count(*) AS n, round(avg(collision), 6) AS collision, round(avg(at_fault_collision), 6) AS at_fault_collision,
  round(avg(drivable_area_violation), 6) AS drivable_area_violation, round(avg(wrong_direction), 6) AS wrong_direction FROM metrics JOIN runs USING (run_id) GROUP BY ALL""",
    "a10_not_at_fault": f"""{_STORE} SELECT agent_mode, round(avg(collision - at_fault_collision) * 100, 6) AS not_at_fault_pct FROM metrics JOIN runs USING (run_id) GROUP BY agent_mode""",
    "j5_paired_modes": f"""{_STORE} SELECT config_name, scenario_id, max(CASE WHEN agent_mode = 'log_replay' THEN at_fault_collision END) AS log_replay,
  max(CASE WHEN agent_mode = 'reactive' THEN at_fault_collision END) AS reactive FROM metrics JOIN runs USING (run_id) GROUP BY ALL HAVING count(DISTINCT agent_mode) = 2""",
    "t9_mode_deltas": f"""{_STORE}, p AS (
  SELECT config_name, scenario_id, max(CASE WHEN agent_mode = 'log_replay' THEN at_fault_collision END) AS a, max(CASE WHEN agent_mode = 'reactive' THEN at_fault_collision END) AS b
  FROM metrics JOIN runs USING (run_id) GROUP BY ALL HAVING count(DISTINCT agent_mode) = 2
) SELECT config_name, count(*) AS n_paired, round(avg(a), 6) AS mean_first, round(avg(b), 6) AS mean_second, round(avg(b - a), 6) AS delta FROM p GROUP BY config_name""",
    "j6_pair_coverage": f"""{_STORE}, a AS (SELECT scenario_id FROM all_metrics WHERE run_id = 'A_F'), b AS (SELECT scenario_id FROM all_metrics WHERE run_id = 'R_F')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_paired, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_only_baseline,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS n_only_candidate""",
    "w1_metric_disagreement": f"""{_STORE}, g AS (
  SELECT config_name, avg(ade) AS ade, avg(collision) AS collision, avg(at_fault_collision) AS at_fault, avg(comfort_violation) AS comfort
  FROM metrics JOIN runs USING (run_id) WHERE agent_mode = 'reactive' GROUP BY config_name
), r AS (
  SELECT config_name, (rank() OVER (ORDER BY ade))::INT AS rank_ade, (rank() OVER (ORDER BY collision))::INT AS rank_collision, (rank() OVER (ORDER BY at_fault))::INT AS rank_at_fault, (rank() OVER (ORDER BY comfort))::INT AS rank_comfort FROM g
), m AS (SELECT *, (rank_collision + rank_at_fault + rank_comfort) / 3 AS mean FROM r)
SELECT config_name, rank_ade, rank_collision, rank_at_fault, rank_comfort, round(mean, 6) AS safety_rank_mean, (rank() OVER (ORDER BY mean))::INT AS rank_safety FROM m""",
    "w2_fisher_bh": f"""{_STORE}, g AS (
  SELECT city, count(*) AS n1, sum(at_fault_collision)::BIGINT AS k1 FROM all_metrics JOIN features USING (scenario_id) WHERE run_id = '{RUN}' GROUP BY city
), c AS (
  SELECT city, k1, n1, (sum(k1) OVER () - k1)::BIGINT AS k0, (sum(n1) OVER () - n1)::BIGINT AS n0 FROM g
), x AS (
  SELECT *, unnest(range(k1, least(n1, k1 + k0) + 1)) AS i FROM c
), t AS (
  SELECT city, k1, n1, k0, n0, least(1.0, sum(exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + lgamma(n0 + 1) - lgamma(k1 + k0 - i + 1) - lgamma(n0 - k1 - k0 + i + 1)
    - lgamma(n1 + n0 + 1) + lgamma(k1 + k0 + 1) + lgamma(n1 + n0 - k1 - k0 + 1)))) AS p FROM x WHERE k1 + k0 - i <= n0 GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER (ORDER BY p) AS j, count(*) OVER () AS m FROM t
), q AS (
  SELECT *, least(1.0, min(p * m / j) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM o
) SELECT city, k1, n1, k0, n0, round(p, 5) AS p_value, round(q, 5) AS q_value, q <= 0.05 AS rejected FROM q""",
    "t5_rate_ratio": f"""{_STORE}, g AS (
  SELECT city, count(*) AS n1, sum(at_fault_collision)::BIGINT AS k1 FROM all_metrics JOIN features USING (scenario_id) WHERE run_id = '{RUN}' GROUP BY city
), c AS (
  SELECT city, k1, n1, (sum(k1) OVER () - k1)::BIGINT AS k0, (sum(n1) OVER () - n1)::BIGINT AS n0 FROM g
), a AS (
  SELECT *, CASE WHEN k1 = 0 OR k0 = 0 THEN 0.5 ELSE 0.0 END AS add FROM c
), r AS (
  SELECT *, (k1 + add) / (n1 + 2 * add) / ((k0 + add) / (n0 + 2 * add)) AS rr, sqrt(1 / (k1 + add) - 1 / (n1 + 2 * add) + 1 / (k0 + add) - 1 / (n0 + 2 * add)) AS se FROM a
) SELECT city, k1, n1, round((k1 / n1) / (k0 / n0), 5) AS ratio, round(rr * exp(-{_Z} * se), 5) AS ratio_lo, round(rr * exp({_Z} * se), 5) AS ratio_hi,
  CASE WHEN add > 0 THEN 'delta_log_haldane' ELSE 'delta_log' END AS method FROM r""",
    "t13_gate_values": f"""{_STORE}, a AS (
  SELECT x.scenario_id, unnest(['at_fault_collision', 'comfort_violation', 'plan_us_p50']) AS metric, unnest([x.at_fault_collision, x.comfort_violation, x.plan_us_p50]) AS a, unnest([y.at_fault_collision, y.comfort_violation, y.plan_us_p50]) AS b
  FROM all_metrics x JOIN all_metrics y ON x.scenario_id = y.scenario_id AND x.run_id = 'A_F' AND y.run_id = 'R_F'
), c AS (
  SELECT 'overall' AS scope, * FROM a UNION ALL SELECT 'city = 1-URGENT', a.* FROM a JOIN features USING (scenario_id) WHERE city = '1-URGENT'
), s AS (
  SELECT scope, metric, count(*) AS n_paired, round(avg(a), 6) AS baseline_val, round(avg(b), 6) AS candidate_val, CASE WHEN count(*) >= 3 THEN round(avg(b) - avg(a), 6) END AS delta FROM c GROUP BY ALL
) SELECT scope, metric, coalesce(n_paired, 0) AS n_paired, baseline_val, candidate_val, delta
FROM (SELECT unnest(['overall', 'city = 1-URGENT']) AS scope) x CROSS JOIN (SELECT unnest(['at_fault_collision', 'comfort_violation', 'plan_us_p50']) AS metric) y LEFT JOIN s USING (scope, metric)""",
    "t13_median_values": f"""{_STORE}, a AS (
  SELECT x.scenario_id, x.plan_us_p50 AS a, y.plan_us_p50 AS b FROM all_metrics x JOIN all_metrics y ON x.scenario_id = y.scenario_id AND x.run_id = 'A_F' AND y.run_id = 'R_F'
), c AS (
  SELECT 'overall' AS scope, * FROM a UNION ALL SELECT 'city = 1-URGENT', a.* FROM a JOIN features USING (scenario_id) WHERE city = '1-URGENT'
), s AS (
  SELECT scope, q, count(*) AS n_paired, CASE WHEN q = 'median' THEN quantile_cont(a, 0.5) ELSE quantile_cont(a, 0.9) END AS a, CASE WHEN q = 'median' THEN quantile_cont(b, 0.5) ELSE quantile_cont(b, 0.9) END AS b FROM c, (VALUES ('median'), ('p90')) v(q) GROUP BY scope, q
) SELECT x.scope, y.q AS statistic, coalesce(n_paired, 0) AS n_paired, round(a, 6) AS baseline_val, round(b, 6) AS candidate_val, CASE WHEN n_paired >= 3 THEN round(b - a, 6) END AS delta
FROM (SELECT unnest(['overall', 'city = 1-URGENT']) AS scope) x CROSS JOIN (SELECT unnest(['median', 'p90']) AS q) y LEFT JOIN s USING (scope, q)""",
    "j14_box_overlaps": """WITH t AS (
  SELECT user_id, event_id, ts::DATE AS day, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y, json_extract_string(props, '$.k')::DOUBLE * pi() / 50 AS heading FROM events
), p AS (
  SELECT e.user_id, e, o, o.x - e.x AS dx, o.y - e.y AS dy FROM t e JOIN t o ON e.user_id = o.user_id AND e.day = o.day AND e.event_id < o.event_id
) SELECT user_id, count(*) AS pairs, count(*) FILTER (WHERE dx * dx + dy * dy <= 40.0 * 40.0 + 16.0 * 16.0 AND TOUCH) AS overlaps FROM p GROUP BY user_id""".replace("TOUCH", touch_sql(20.0, 8.0)),
    "i6_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "i7_orphan_scenarios": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderstatus",
    "p6_rule_counts": f"""{_STORE}, x AS (SELECT * FROM all_metrics JOIN features USING (scenario_id) WHERE run_id = '{RUN}'), e AS (SELECT count(*) AS n_all, avg(at_fault_collision) AS base FROM x), r AS (
  {" UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n, coalesce(sum(at_fault_collision), 0)::BIGINT AS k FROM x WHERE {where}" for name, where in _RULES)}
) SELECT rule, n, k, round(k / n, 6) AS rate, round(n / n_all * (k / n - base), 6) AS wracc FROM r CROSS JOIN e""",
    "w4_arc_length": """WITH t AS (
  SELECT user_id, ts, event_id, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y FROM events
), d AS (
  SELECT user_id, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
) SELECT user_id, count(*) AS n, round(sum(step), 6) AS arc, round(max(step), 6) AS longest FROM d GROUP BY user_id""",
    "a12_speed_percentile": "SELECT event_type, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN greatest(2.0, least(22.0, quantile_cont(value, 0.85))) ELSE 13.4 END, 6) AS prior FROM events GROUP BY event_type",
}
