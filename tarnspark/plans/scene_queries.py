"""Queries of the scene, cycle, ingest and mining operators over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnspark.operators import bootstrap, cycles, miner, scene
from tarnspark.plans import adapters
from tarnspark.plans.queries import touch_sql
from tarnspark.sources import ingest, store

KINDS = ("vehicle", "pedestrian", "cyclist", "bus", "motorcyclist")
#: The last day of a user's first scenario in i19.
SPLIT_DAY = 18
#: An L-shaped area.
RING = [(0.0, 0.0), (150.0, 0.0), (150.0, 40.0), (60.0, 40.0), (60.0, 80.0), (0.0, 80.0)]


def _rounded(df: DataFrame, digits: int = 6, signed: tuple[str, ...] = ()) -> DataFrame:
    """df with its doubles rounded; in the columns signed a zero keeps the sign of what was rounded to it, as in DuckDB."""
    near = lambda c: F.when(F.round(c, digits) == 0, F.col(c) * 0.0).otherwise(F.round(c, digits)) if c in signed else F.round(c, digits)
    return df.select(*[(near(c).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


def _states(s: SparkSession, d: str) -> DataFrame:
    """Events as states: a user's events in order of time are a track."""
    k = F.get_json_object("props", "$.k").cast("int")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = adapters.load(s, d, "events").select("event_id", "user_id", "ts", "event_type", F.col("value").alias("x"), k.cast("double").alias("y"), k.alias("k"))
    return e.withColumn("step", F.row_number().over(w) - 1).withColumn("heading", F.col("k") * F.pi() / 50)


def cycle_table(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    e = _states(s, d)
    return e.select(
        F.lit("r1").alias("run_id"), c("user_id").alias("scenario_id"), "step", (c("step") * 0.1).alias("t"), "x", "y", (c("y") / 5).alias("v"),
        F.when(c("k") % 7 != 0, (c("x") - 50) / 20).alias("a_lon"), (c("y") / 25).alias("a_lat"), ((c("y") - 50) / 6).alias("jerk"), ((c("y") - 50) / 60).alias("yaw_rate"),
        (c("step") * 3.0).alias("s"), F.lit(60.0).alias("path_length"), (c("x") / 10).alias("speed_prior"), F.when(c("k") % 3 == 0, c("y") / 200).alias("offroad"),
        (c("y") / 60).alias("heading_error"), F.when(c("k") % 2 == 0, c("y") / 40).alias("min_ttc"), F.when(c("k") >= 97, c("k")).alias("collision_agent"),
        F.when(c("k") >= 97, c("k") % 3).alias("collision_agent_type"), (c("k") % 2 == 0).alias("ego_struck_from_behind"),
        F.when(c("k") % 5 != 0, c("x") + 1).alias("log_x"), F.when(c("k") % 5 != 0, c("y") * 1.1).alias("log_y"), (c("x") * 10 + c("k")).alias("plan_us"), (c("k") > 20).alias("refine_converged"),
    )


def a11_scenario_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rounded(cycles.scenario_metrics(cycle_table(s, d)), 5)


def m9_kinematics(s: SparkSession, d: str) -> DataFrame:
    states = _states(s, d).select(F.lit("r1").alias("run_id"), F.col("user_id").alias("scenario_id"), "step", (F.col("y") / 5).alias("v"), "heading")
    return _rounded(cycles.kinematics(states, 0.1).groupBy("scenario_id").agg(*[F.max(F.abs(c)).alias(f"max_{c}") for c in ("a_lon", "yaw_rate", "a_lat", "jerk")]), 4)


def _boxes(states: DataFrame) -> DataFrame:
    f = F.col("heading")
    return states.select("scenario_id", "step", "x", "y", "heading", (F.cos(f) * 12).alias("vx"), (F.sin(f) * 12).alias("vy"), F.lit(4.8).alias("length"), F.lit(2.0).alias("width"))


def _pairs_of_tracks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Egos (users of even id) and agents (the next user of odd id), a scenario for each such pair."""
    e = _states(s, d).withColumn("scenario_id", F.floor(F.col("user_id") / 2))
    return _boxes(e.where("user_id % 2 = 0")), _boxes(e.where("user_id % 2 = 1"))


def m3_time_to_collision(s: SparkSession, d: str) -> DataFrame:
    return _rounded(scene.time_to_collision(*_pairs_of_tracks(s, d)), 4)


def m2_struck_from_behind(s: SparkSession, d: str) -> DataFrame:
    ego, agents = _pairs_of_tracks(s, d)
    other = agents.select("scenario_id", "step", *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "vx", "vy")])
    c = F.col
    hit = scene.struck_from_behind(c("x"), c("y"), c("heading"), F.lit(8.0), c("o_x"), c("o_y"), c("o_vx"), c("o_vy"))
    return ego.join(other, ["scenario_id", "step"]).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("n_struck"))


def scene_agents(s: SparkSession, d: str, size: int = 6) -> DataFrame:
    """Tracks as agents, so many a scenario; agent 0 is the ego. A state in four is not valid, but for the ego's."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 7 % len(KINDS) + 1).cast("int"))
    e = _states(s, d).withColumns({"scenario_id": F.floor(F.col("user_id") / size), "agent_idx": (F.col("user_id") % size).cast("int"), "kind": kind})
    return e.withColumn("valid", (F.col("agent_idx") == 0) | (F.col("k") % 4 != 0))


def f3_first_step_features(s: SparkSession, d: str) -> DataFrame:
    a = scene_agents(s, d)
    return _rounded(scene.first_step_features(a.where("agent_idx = 0 AND step = 0"), a.where("agent_idx > 0")), 5)


def f8_ego_speeds(s: SparkSession, d: str) -> DataFrame:
    return _rounded(scene.ego_speed_features(_states(s, d).select(F.col("user_id").alias("scenario_id"), "step", F.when(F.col("k") % 4 != 3, F.col("y") / 8).alias("v"))))


def f1_maneuvers(s: SparkSession, d: str) -> DataFrame:
    e = _states(s, d).groupBy("user_id").agg(F.min_by("heading", "step").alias("a"), F.max_by("heading", "step").alias("b"), F.count(F.when(F.col("k") > 95, 1)).alias("changes"))
    return e.select(scene.maneuver(F.col("a"), F.col("b"), F.col("changes")).alias("ego_maneuver")).groupBy("ego_maneuver").agg(F.count(F.lit(1)).alias("n"))


def j15_area_distances(s: SparkSession, d: str) -> DataFrame:
    points = _states(s, d).select((F.col("user_id") % 4).alias("scenario_id"), F.col("event_id").alias("point_id"), "x", "y")
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    shifted = F.transform(ring, lambda p: F.struct((p["x"] + F.col("scenario_id") * 10).alias("x"), p["y"].alias("y")))
    return _rounded(scene.area_distances(points, s.range(3).select(F.col("id").alias("scenario_id"), "id").select("scenario_id", shifted.alias("ring"))), 5)


def _track_rows(s: SparkSession, d: str) -> DataFrame:
    """Two scenarios a user, by the day of the month, so that their number grows with the table."""
    e = adapters.load(s, d, "events")
    return e.select((F.col("user_id") * 2 + (F.dayofmonth("ts") > SPLIT_DAY).cast("int")).alias("scenario_id"), F.when(F.col("event_type") == "click", "AV").otherwise(F.col("event_type")).alias("track_id"), F.minute("ts").alias("timestep"), "event_id", F.col("value").alias("position_x"), F.get_json_object("props", "$.k").cast("double").alias("position_y"))


def i21_dense_tracks(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ingest.densify(_track_rows(s, d), "event_id", 60))


def i20_recentred(s: SparkSession, d: str) -> DataFrame:
    rows = ingest.densify(_track_rows(s, d), "event_id", 60).where("valid")
    return _rounded(ingest.recentred(rows).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.min("position_x").alias("low"), F.max("position_y").alias("high")))


def i19_reject_reasons(s: SparkSession, d: str) -> DataFrame:
    """Scenarios judged by their tracks alone."""
    rows = _track_rows(s, d)
    last = ingest.last_states(rows, "event_id").select("scenario_id", "track_id", "timestep", "state.*")
    return ingest.reason_counts(ingest.reject_reasons(last, n_steps=30))


def i19_all_reasons(s: SparkSession, d: str) -> DataFrame:
    """The same scenarios by all rules. Some have a file that is missing, can't be read or is empty, and some
    have too few lanes."""
    rows = _track_rows(s, d)
    last = ingest.last_states(rows, "event_id").select("scenario_id", "track_id", "timestep", "state.*").where("scenario_id % 29 <> 3")
    every = rows.select("scenario_id").distinct()
    files = every.select("scenario_id", F.when(F.col("scenario_id") % 31 == 1, "missing_input_files").when(F.col("scenario_id") % 31 == 2, "parse_error:ArrowInvalid").alias("reason"))
    lanes = every.select("scenario_id", F.explode(F.sequence(F.lit(1), (F.col("scenario_id") % 5).cast("int") + 1))).select("scenario_id", F.lit("VEHICLE").alias("lane_type"))
    return ingest.reason_counts(ingest.reject_reasons(last, lanes, files, n_steps=30, min_travel=40.0))


def t1_cluster_bootstrap(s: SparkSession, d: str) -> DataFrame:
    return bootstrap.cluster_bootstrap(adapters.load(s, d, "events").select("event_type", "user_id", "value"), ["event_type"], "user_id", "value", seed=7, n_boot=2000)


def t12_failure_classes(s: SparkSession, d: str) -> DataFrame:
    x = adapters.metrics(s, d).where("run_id = 'A_F'").select("scenario_id", "at_fault_collision", "n_cycles").join(adapters.features(s, d), "scenario_id")
    x = x.withColumn("split", store.split_of(F.concat(F.lit("scn-"), F.col("scenario_id").cast("string"))))
    return miner.mine(x, ["n_cycles", "ego_maneuver", "city", "route_len_m", "ego_speed_t0"], "at_fault_collision", n_boot=2000, seed=11)


QUERIES = {
    f.__name__: f
    for f in (a11_scenario_metrics, m9_kinematics, m3_time_to_collision, m2_struck_from_behind, f3_first_step_features, f8_ego_speeds, f1_maneuvers, j15_area_distances, i21_dense_tracks, i20_recentred, i19_reject_reasons, i19_all_reasons, t1_cluster_bootstrap, t12_failure_classes)
}

_STATES = """s AS (
  SELECT event_id, user_id, ts, event_type, value AS x, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.k')::DOUBLE AS y,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, json_extract_string(props, '$.k')::INT * pi() / 50 AS heading FROM events
)"""
AGENTS = """g AS (
  SELECT *, user_id // 6 AS scenario_id, user_id % 6 AS agent_idx, user_id % 6 = 0 OR k % 4 <> 0 AS valid, ['vehicle', 'pedestrian', 'cyclist', 'bus', 'motorcyclist'][(user_id % 7 % 5 + 1)::INT] AS kind FROM s
)"""
_WRAP = lambda a: f"atan2(sin({a}), cos({a}))"
_DIST = "sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2)"
_BOXES = """b AS (SELECT user_id // 2 AS scenario_id, user_id % 2 AS odd, step, x, y, heading, cos(heading) * 12 AS vx, sin(heading) * 12 AS vy FROM s)"""


_TOUCH = touch_sql(2.4, 1.0)
_EDGES = ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip([RING[-1], *RING[:-1]], RING, strict=True))
_TRACKS = """r AS (
  SELECT user_id * 2 + (extract(day FROM ts) > 18)::INT AS scenario_id, CASE WHEN event_type = 'click' THEN 'AV' ELSE event_type END AS track_id, extract(minute FROM ts)::INT AS timestep, event_id,
    value AS position_x, json_extract_string(props, '$.k')::DOUBLE AS position_y FROM events
), l AS (
  SELECT scenario_id, track_id, timestep, max_by(position_x, event_id) AS position_x, max_by(position_y, event_id) AS position_y, count(*) - 1 AS n_repeats FROM r GROUP BY ALL
)"""

_SCENES = f"""r AS (
  SELECT user_id * 2 + (extract(day FROM ts) > {SPLIT_DAY})::INT AS scenario_id, CASE WHEN event_type = 'click' THEN 'AV' ELSE event_type END AS track_id, extract(minute FROM ts)::INT AS timestep, event_id,
    value AS x, json_extract_string(props, '$.k')::DOUBLE AS y FROM events
), l AS (
  SELECT scenario_id, track_id, timestep, max_by(x, event_id) AS x, max_by(y, event_id) AS y FROM r GROUP BY ALL
)"""
_STEP = "0.1::FLOAT::DOUBLE"
ORACLE_SQL = {
    "a11_scenario_metrics": f"""WITH {_STATES}, c AS (
  SELECT user_id AS scenario_id, step, step * 0.1::DOUBLE AS t, x, y, k, y / 5 AS v, CASE WHEN k % 7 <> 0 THEN (x - 50) / 20 END AS a_lon, y / 25 AS a_lat, (y - 50) / 6 AS jerk, (y - 50) / 60 AS yaw_rate,
    x / 10 AS prior, CASE WHEN k % 3 = 0 THEN y / 200 END AS offroad, y / 60 AS herr, CASE WHEN k % 2 = 0 THEN y / 40 END AS ttc, k >= 97 AS hit,
    CASE WHEN k % 5 <> 0 THEN x + 1 END AS lx, CASE WHEN k % 5 <> 0 THEN y * 1.1 END AS ly, x * 10 + k AS us FROM s
), d AS (
  SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS arc, sqrt((lx - lag(lx) OVER w) ** 2 + (ly - lag(ly) OVER w) ** 2) AS larc, sqrt((x - lx) ** 2 + (y - ly) ** 2) AS off
  FROM c WINDOW w AS (PARTITION BY scenario_id ORDER BY step)
), g AS (
  SELECT scenario_id, count(*) AS n_cycles, bool_or(hit)::INT AS collision, coalesce(min_by(k % 2 <> 0, step) FILTER (WHERE hit), FALSE)::INT AS at_fault_collision, min(t) FILTER (WHERE hit) AS collision_time,
    (min_by(k % 3, step) FILTER (WHERE hit))::INT AS collision_agent_type, min(ttc) AS min_ttc, coalesce(avg((ttc < 0.95)::INT), 0.0) AS ttc_below_thresh_frac,
    coalesce(avg((v > 1.05 * prior)::INT) FILTER (WHERE prior > 0.5), 0.0) AS speeding_frac, max(offroad) AS max_offroad_dist, max((abs(herr) > pi() / 2)::INT) AS wrong_direction,
    max(abs(a_lon)) AS max_abs_a_lon, max(abs(a_lat)) AS max_abs_a_lat, max(abs(jerk)) AS max_abs_jerk, max(abs(yaw_rate)) AS max_abs_yaw_rate,
    sum(arc) AS arc, sum(larc) AS larc, max(step) * 3.0 AS last_s, avg(off) AS ade, max_by(off, step) FILTER (WHERE off IS NOT NULL) AS fde,
    quantile_cont(us, 0.5) AS plan_us_p50, quantile_cont(us, 0.99) AS plan_us_p99, avg(us) AS plan_us_mean, max(us) AS plan_us_max, avg((k > 20)::INT) AS refine_converged_frac FROM d GROUP BY scenario_id
) SELECT 'r1' AS run_id, scenario_id, n_cycles, collision, at_fault_collision, round(collision_time, 5) AS collision_time, collision_agent_type, round(min_ttc, 5) AS min_ttc, round(ttc_below_thresh_frac, 5) AS ttc_below_thresh_frac,
  round(speeding_frac, 5) AS speeding_frac, round(max_offroad_dist, 5) AS max_offroad_dist, (max_offroad_dist > 0.3)::INT AS drivable_area_violation, wrong_direction,
  round(max_abs_a_lon, 5) AS max_abs_a_lon, round(max_abs_a_lat, 5) AS max_abs_a_lat, round(max_abs_jerk, 5) AS max_abs_jerk, round(max_abs_yaw_rate, 5) AS max_abs_yaw_rate,
  (coalesce(max_abs_a_lon > 4.05, FALSE) OR max_abs_a_lat > 4.89 OR max_abs_jerk > 8.37 OR max_abs_yaw_rate > 0.95)::INT AS comfort_violation,
  round(CASE WHEN larc > 0.5 THEN arc / larc END, 5) AS progress_ratio, round(greatest(0.0, least(1.0, last_s / 60)), 5) AS route_completion, round(ade, 5) AS ade, round(fde, 5) AS fde,
  round(plan_us_p50, 5) AS plan_us_p50, round(plan_us_p99, 5) AS plan_us_p99, round(plan_us_mean, 5) AS plan_us_mean, round(plan_us_max, 5) AS plan_us_max, round(refine_converged_frac, 5) AS refine_converged_frac, 'ok' AS status FROM g""",
    "m9_kinematics": f"""WITH {_STATES}, a AS (
  SELECT user_id AS scenario_id, step, y / 5 AS v, (y / 5 - lag(y / 5) OVER w) / 0.1 AS a_lon, {_WRAP("heading - lag(heading) OVER w")} / 0.1 AS yaw_rate FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)
), j AS (
  SELECT *, coalesce((lead(a_lon) OVER w - lag(a_lon) OVER w) / 0.2, (lead(a_lon) OVER w - a_lon) / 0.1, (a_lon - lag(a_lon) OVER w) / 0.1) AS jerk FROM a WINDOW w AS (PARTITION BY scenario_id ORDER BY step)
) SELECT scenario_id, round(max(abs(a_lon)), 4) AS max_a_lon, round(max(abs(yaw_rate)), 4) AS max_yaw_rate, round(max(abs(v * yaw_rate)), 4) AS max_a_lat, round(max(abs(jerk)), 4) AS max_jerk FROM j GROUP BY scenario_id""",
    "m3_time_to_collision": f"""WITH {_STATES}, {_BOXES}, p AS (
  SELECT e.scenario_id, e.step, i * {_STEP} AS t, o.x + i * {_STEP} * o.vx - e.x - i * {_STEP} * e.vx AS dx, o.y + i * {_STEP} * o.vy - e.y - i * {_STEP} * e.vy AS dy, e, o
  FROM b e JOIN b o ON e.scenario_id = o.scenario_id AND e.step = o.step AND e.odd = 0 AND o.odd = 1 AND {_DIST} <= 60 CROSS JOIN range(1, 30) k(i)
), m AS (
  SELECT scenario_id, step, min(t) AS min_ttc FROM p WHERE dx * dx + dy * dy <= 4.8 * 4.8 + 2.0 * 2.0 AND {_TOUCH} GROUP BY ALL
) SELECT b.scenario_id, b.step, round(min_ttc, 4) AS min_ttc FROM b LEFT JOIN m USING (scenario_id, step) WHERE odd = 0""",
    "m2_struck_from_behind": f"""WITH {_STATES}, {_BOXES}
SELECT e.scenario_id, count(*) AS n, count(*) FILTER (WHERE (o.x - e.x) * cos(e.heading) + (o.y - e.y) * sin(e.heading) <= -0.725 AND o.vx * cos(e.heading) + o.vy * sin(e.heading) > 8.5) AS n_struck
FROM b e JOIN b o ON e.scenario_id = o.scenario_id AND e.step = o.step AND e.odd = 0 AND o.odd = 1 GROUP BY e.scenario_id""",
    "f3_first_step_features": f"""WITH {_STATES}, {AGENTS}, t AS (
  SELECT scenario_id, agent_idx, kind, bool_or(valid) AS ever, min(step) FILTER (WHERE step = 0 AND valid) AS at0 FROM g WHERE agent_idx > 0 GROUP BY ALL
), p AS (
  SELECT e.scenario_id, t.agent_idx AS other, t.kind, CASE WHEN at0 = 0 THEN {_DIST} END AS away, CASE WHEN at0 = 0 THEN abs({_WRAP("o.heading - e.heading")}) END AS turn,
    CASE WHEN at0 = 0 THEN (o.x - e.x) * cos(e.heading) + (o.y - e.y) * sin(e.heading) END AS along, (o.y - e.y) * cos(e.heading) - (o.x - e.x) * sin(e.heading) AS aside
  FROM g e LEFT JOIN t ON t.scenario_id = e.scenario_id AND ever LEFT JOIN g o ON o.scenario_id = e.scenario_id AND o.agent_idx = t.agent_idx AND o.step = 0 WHERE e.step = 0 AND e.agent_idx = 0
) SELECT scenario_id, count(other) AS n_agents, count(*) FILTER (WHERE kind IN ('vehicle', 'bus')) AS n_vehicles, count(*) FILTER (WHERE kind = 'pedestrian') AS n_peds, count(*) FILTER (WHERE kind IN ('cyclist', 'motorcyclist')) AS n_cyclists,
  count(*) FILTER (WHERE away <= 30) AS n_agents_within_30m, round(min(away), 5) AS min_agent_dist_t0, count(*) FILTER (WHERE away <= 40 AND turn > 2 * pi() / 3) AS n_oncoming_within_40m,
  count(*) FILTER (WHERE away <= 40 AND turn > pi() / 3 AND turn <= 2 * pi() / 3) AS n_crossing_within_40m, round(min(along) FILTER (WHERE along > 0 AND along <= 60 AND abs(aside) <= 2), 5) AS lead_agent_gap FROM p GROUP BY scenario_id""",
    "f8_ego_speeds": f"""WITH {_STATES}, v AS (SELECT user_id, step, CASE WHEN k % 4 <> 3 THEN y / 8 END AS v FROM s), g AS (
  SELECT user_id AS scenario_id, coalesce(max(v) FILTER (WHERE step = 0), 0.0) AS a, coalesce(avg(v), 0.0) AS m, coalesce(max(v), 0.0) AS b, count(*) FILTER (WHERE v < 0.5) AS ego_stops FROM v GROUP BY user_id
) SELECT scenario_id, round(a, 6) AS ego_speed_t0, round(m, 6) AS ego_mean_speed, round(b, 6) AS ego_max_speed, ego_stops, CASE WHEN m < 1 THEN 'stopped' WHEN m < 5 THEN 'low' WHEN m < 11 THEN 'mid' ELSE 'high' END AS speed_regime FROM g""",
    "f1_maneuvers": f"""WITH {_STATES}, g AS (
  SELECT user_id, min_by(k, step) AS a, max_by(k, step) AS b, count(*) FILTER (WHERE k > 95) AS changes FROM s GROUP BY user_id
), t AS (SELECT *, CASE WHEN b - a > 50 THEN b - a - 100 WHEN b - a <= -50 THEN b - a + 100 ELSE b - a END * 3.6 AS turn FROM g)
SELECT CASE WHEN abs(turn) > 150 THEN 'uturn' WHEN turn > 35 THEN 'left' WHEN turn < -35 THEN 'right' WHEN changes > 0 THEN 'lane_change' ELSE 'straight' END AS ego_maneuver, count(*) AS n FROM t GROUP BY 1""",
    "j15_area_distances": f"""WITH {_STATES}, e(ax, ay, zx, zy) AS (VALUES {_EDGES}), p AS (
  SELECT user_id % 4 AS scenario_id, event_id AS point_id, x - user_id % 4 * 10 AS x, y FROM s
), q AS (
  SELECT scenario_id, point_id, sum(((ay > y) <> (zy > y) AND x < ax + (y - ay) * (zx - ax) / nullif(zy - ay, 0))::INT) % 2 = 1 AS inside,
    min(sqrt((x - ax - u * (zx - ax)) ** 2 + (y - ay - u * (zy - ay)) ** 2)) AS away
  FROM (SELECT *, greatest(0.0, least(1.0, ((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / ((zx - ax) ** 2 + (zy - ay) ** 2))) AS u FROM p CROSS JOIN e) GROUP BY ALL
) SELECT scenario_id, point_id, CASE WHEN scenario_id < 3 THEN inside END AS inside, CASE WHEN scenario_id < 3 THEN round(CASE WHEN inside THEN 0.0 ELSE away END, 5) END AS distance FROM q""",
    "i21_dense_tracks": f"""WITH {_TRACKS}, a AS (SELECT scenario_id, track_id, (row_number() OVER (PARTITION BY scenario_id ORDER BY track_id) - 1)::INT AS agent_idx FROM (SELECT DISTINCT scenario_id, track_id FROM l))
SELECT a.scenario_id, a.track_id, g.i::INT AS timestep, agent_idx, l.timestep IS NOT NULL AS valid, coalesce(n_repeats, 0) AS n_repeats, round(position_x, 6) AS position_x, round(position_y, 6) AS position_y
FROM a CROSS JOIN range(60) g(i) LEFT JOIN l ON l.scenario_id = a.scenario_id AND l.track_id = a.track_id AND l.timestep = g.i""",
    "i20_recentred": f"""WITH {_TRACKS}, z AS (SELECT scenario_id, position_x AS ox, position_y AS oy FROM l WHERE track_id = 'AV' AND timestep = 0)
SELECT scenario_id, count(*) AS n, round(min(position_x - ox), 6) AS low, round(max(position_y - oy), 6) AS high FROM l JOIN z USING (scenario_id) GROUP BY scenario_id""",
    "i19_reject_reasons": f"""WITH {_SCENES}, d AS (
  SELECT *, track_id = 'AV' AS ego, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM l WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY timestep)
), g AS (
  SELECT scenario_id, count(DISTINCT timestep) AS steps, count(*) FILTER (WHERE ego) AS n, min(timestep) FILTER (WHERE ego) AS first, coalesce(sum(step) FILTER (WHERE ego), 0.0) AS travel FROM d GROUP BY scenario_id
) SELECT CASE WHEN steps <> 30 THEN 'unexpected_num_timestamps' WHEN n = 0 THEN 'no_av_track' WHEN first <> 0 THEN 'av_not_valid_at_t0' WHEN travel < 5.0 THEN 'ego_travel_below_5m' END AS reason, count(*) AS n FROM g GROUP BY 1""",
    "i19_all_reasons": f"""WITH {_SCENES}, d AS (
  SELECT *, track_id = 'AV' AS ego, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM l WHERE scenario_id % 29 <> 3 WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY timestep)
), g AS (
  SELECT scenario_id, count(DISTINCT timestep) AS steps, count(*) FILTER (WHERE ego) AS n, min(timestep) FILTER (WHERE ego) AS first, coalesce(sum(step) FILTER (WHERE ego), 0.0) AS travel FROM d GROUP BY scenario_id
), e AS (SELECT DISTINCT scenario_id FROM r)
SELECT CASE WHEN e.scenario_id % 31 = 1 THEN 'missing_input_files' WHEN e.scenario_id % 31 = 2 THEN 'parse_error' WHEN steps IS NULL THEN 'empty_parquet' WHEN steps <> 30 THEN 'unexpected_num_timestamps'
  WHEN n = 0 THEN 'no_av_track' WHEN first <> 0 THEN 'av_not_valid_at_t0' WHEN travel < 40.0 THEN 'ego_travel_below_5m' WHEN e.scenario_id % 5 = 0 THEN 'fewer_than_2_vehicle_lanes' END AS reason, count(*) AS n
FROM e LEFT JOIN g USING (scenario_id) GROUP BY 1""",
}
