"""Queries of routes, reference paths and logged egos over the driver's tables, with their SQL for DuckDB.

Five suppliers are the lanes of a scene: 0, 1 and 2 follow each other, 3 and 4 run beside 0 and 1, and 4 leads into 2. Seven users are its
egos: each asks for a route from its first event to its last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.operators import cycles, lanes, logged, routes, scene, trace
from tarnspark.plans import adapters
from tarnspark.plans.lane_queries import SCENE_LANES, SCENE_USERS
from tarnspark.plans.queries import touch_sql
from tarnspark.plans.scene_queries import _STATES, _rounded, _states
from tarnspark.sources import scenes
from tarnspark.sources.work import kept, work_folder

#: Lanes by their place in the scene: x and y of their start.
PLACES = ((0.0, 0.0), (40.0, 0.0), (80.0, 0.0), (0.0, 3.5), (40.0, 3.5))
#: Kinds of agents, and an area.
KINDS = ("vehicle", "pedestrian", "static", "bus")
AREA = ((0.0, -2.0), (110.0, -2.0), (110.0, 6.0), (60.0, 6.0), (60.0, 3.0), (0.0, 3.0))
#: Edges by place.
LINKS = (("succ", 0, 1), ("succ", 1, 2), ("succ", 3, 4), ("succ", 4, 2), ("left", 0, 3), ("left", 1, 4), ("right", 3, 0), ("right", 4, 1))


def road(s: SparkSession, d: str) -> DataFrame:
    """Lanes of three points; the middle one lies off the line, by the balance. A lane in five is a bike lane."""
    c = F.col
    place = F.element_at(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in PLACES]), (c("s_suppkey") % SCENE_LANES + 1).cast("int"))
    point = lambda dx, dy: F.struct((place["x"] + dx).alias("x"), (place["y"] + dy).alias("y"))
    points = F.array(point(0.0, F.lit(0.0)), point(20.0, F.pmod(F.abs("s_acctbal"), F.lit(2.0)) - 1.0), point(40.0, F.lit(0.0)))
    return adapters.load(s, d, "supplier").select(
        F.floor(c("s_suppkey") / SCENE_LANES).alias("scenario_id"), c("s_suppkey").alias("lane_idx"), points.alias("points"), F.when(c("s_nationkey") % 5 == 4, "BIKE").otherwise("VEHICLE").alias("lane_type"),
        (c("s_nationkey") % 10 + 1).cast("double").alias("speed_prior"), (c("s_nationkey") % 3 == 0).alias("is_intersection"), (c("s_nationkey") % 4 == 1).alias("has_stop_sign"),
    )


def links(s: SparkSession, d: str) -> DataFrame:
    own = adapters.load(s, d, "supplier").select(F.floor(F.col("s_suppkey") / SCENE_LANES).alias("scenario_id")).distinct()
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in LINKS]))
    first = F.col("scenario_id") * SCENE_LANES
    return own.select("scenario_id", every.alias("e")).select("scenario_id", (first + F.col("e.a")).alias("src"), (first + F.col("e.b")).alias("dst"), "e.kind")


def requests(s: SparkSession, d: str) -> DataFrame:
    """From about a user's first event to its last."""
    g = _states(s, d).groupBy("user_id").agg(F.min_by(F.struct("x", "k"), "step").alias("a"), F.max_by(F.struct("x", "k"), "step").alias("b"))
    c = F.col
    return g.select(
        F.floor(c("user_id") / SCENE_USERS).alias("scenario_id"), c("user_id").alias("request_id"), (c("a.x") * 0.6).alias("x"), (c("a.k") % 12 / 2 - 1.0).alias("y"), ((c("a.k") - 50) * 0.035).alias("heading"),
        (F.lit(50.0) + c("b.x") * 0.7).alias("goal_x"), (c("b.k") % 14 - 2).cast("double").alias("goal_y"),
    )


def found(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    graph = kept(routes.lane_graph(road(s, d)), "lane-graph")
    return graph, kept(routes.find_routes(graph, links(s, d), requests(s, d)), "routes")


def r1_lane_graph(s: SparkSession, d: str) -> DataFrame:
    """Lanes by length, last heading, sharpest curvature and the sum of their samples' places; and the pose halfway."""
    g = routes.lane_graph(road(s, d))
    c, at = F.col, routes.lane_pose(F.col("samples"), F.col("length") / 2)
    total = lambda a: F.aggregate("samples", F.lit(0.0), lambda acc, p: acc + p[a])
    out = g.select("scenario_id", "lane_idx", "length", F.size("samples").alias("n_samples"), total("x").alias("sum_x"), total("y").alias("sum_y"), F.element_at("samples", -1)["heading"].alias("last_heading"), F.array_max(F.transform("samples", lambda p: F.abs(p["curvature"]))).alias("max_curvature"), *[x.alias(f"half_{n}") for x, n in zip(at, ("x", "y", "heading"), strict=True)])
    return _rounded(out.withColumn("max_curvature", F.round(c("max_curvature"), 4)))


def r2_routes(s: SparkSession, d: str) -> DataFrame:
    _, r = found(s, d)
    step = F.transform("route", lambda h: F.concat(F.when(h["lane_change"], ">").otherwise(""), h["lane_idx"].cast("string")))
    return _rounded(r.select("scenario_id", "request_id", "status", "cost", "start_s", "goal_s", F.array_join(step, " ").alias("route")), 5)


def r4_reference_paths(s: SparkSession, d: str) -> DataFrame:
    graph, r = found(s, d)
    p = routes.reference_paths(r, graph)
    return _rounded(p.select("scenario_id", "request_id", "length", F.explode("path").alias("p")).select("scenario_id", "request_id", "length", "p.*"))


def r5_frenet(s: SparkSession, d: str) -> DataFrame:
    """Every event of a user along the user's path."""
    graph, r = found(s, d)
    c = F.col
    points = _states(s, d).select(F.floor(c("user_id") / SCENE_USERS).alias("scenario_id"), c("user_id").alias("request_id"), c("event_id").alias("point_id"), (c("x") * 1.2).alias("x"), (c("k") % 10 - 4).cast("double").alias("y"), "heading", (c("k") / 4).alias("v"))
    return _rounded(routes.to_frenet(points, routes.reference_paths(r, graph), ["scenario_id", "request_id"]))


def f2_route_features(s: SparkSession, d: str) -> DataFrame:
    """Features of reference paths that were found, not of made-up arrays."""
    graph, r = found(s, d)
    p = routes.route_features(r, routes.reference_paths(r, graph), graph).withColumnRenamed("scenario_id", "scene").withColumnRenamed("request_id", "scenario_id")
    return _rounded(lanes.path_features(p))


def tracks(s: SparkSession, d: str) -> DataFrame:
    """Seven users' tracks a scene, the first the ego's; a state in four is not valid."""
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (c("user_id") % len(KINDS) + 1).cast("int"))
    e = _states(s, d).withColumns({"scenario_id": F.floor(c("user_id") / SCENE_USERS), "agent_idx": (c("user_id") % SCENE_USERS).cast("int"), "kind": kind})
    return e.select(
        "scenario_id", "agent_idx", "step", (c("k") % 4 != F.when(c("agent_idx") == 0, 3).otherwise(0)).alias("valid"), "kind", (c("x") * 1.2).alias("x"), (c("k") % 10 - 4).cast("double").alias("y"), "heading",
        (F.cos("heading") * 12).alias("vx"), (F.sin("heading") * 12).alias("vy"), F.lit(4.8).alias("length"), F.lit(2.0).alias("width"),
    )


def areas(s: SparkSession, d: str) -> DataFrame:
    """An L-shaped area in three scenes of four."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in AREA])
    return adapters.load(s, d, "supplier").select(F.floor(F.col("s_suppkey") / SCENE_LANES).alias("scenario_id")).distinct().where("scenario_id % 4 < 3").select("scenario_id", ring.alias("ring"))


def m6_logged_states(s: SparkSession, d: str) -> DataFrame:
    """What a logged ego meets at each step: how far its worst corner is off the area, its turn against the lanes, time to collision, the agent that it touches."""
    t, key = kept(tracks(s, d), "tracks"), ["scenario_id", "step"]
    c, ego = F.col, kept(logged.ego_states(t), "ego")
    others = t.where("agent_idx > 0 AND valid")
    boxed = ego.select(*key, "x", "y", "heading", (c("v") * F.cos("heading")).alias("vx"), (c("v") * F.sin("heading")).alias("vy"), F.lit(4.8).alias("length"), F.lit(2.0).alias("width"))
    out = ego.select(*key, "x", "y", "v", "a_lon", F.abs("yaw_rate").alias("yaw_rate"), "jerk")  # an exact half turn has no sign
    out = out.join(logged.off_road(ego, areas(s, d)), key, "left").join(logged.collisions(ego, others), key, "left").join(scene.time_to_collision(boxed, others), key)
    turned = lanes.wrong_direction(ego.withColumnRenamed("step", "point_id"), road(s, d)).withColumnRenamed("point_id", "step")
    return _rounded(out.join(turned, key), 4, signed=("a_lon", "jerk"))


def r17_logged_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics of logged egos from raw tracks, lanes and areas, with the status of every scene."""
    t = kept(tracks(s, d), "tracks")
    graph = kept(routes.lane_graph(road(s, d)), "lane-graph")
    ego = t.where("agent_idx = 0")
    ends = ego.groupBy("scenario_id").agg(F.min_by(F.struct("x", "y", "heading"), "step").alias("a"), F.max_by(F.struct("x", "y"), F.when(F.col("valid"), F.col("step"))).alias("b"))
    asked = ends.select("scenario_id", F.col("scenario_id").alias("request_id"), "a.*", F.col("b.x").alias("goal_x"), F.col("b.y").alias("goal_y"))
    found = kept(routes.find_routes(graph, links(s, d), asked), "routes")
    paths = kept(routes.reference_paths(found, graph), "paths")
    m = cycles.scenario_metrics(logged.logged_cycles(t, road(s, d), areas(s, d), paths)).drop("status", "run_id")
    return _rounded(logged.statuses(t, found, paths).join(m, "scenario_id", "left"), 5)


def i36_scene_view(s: SparkSession, d: str) -> DataFrame:
    """Scenes as nested views, written as dumps and read back through the contract's checks."""
    t = kept(tracks(s, d), "tracks")
    every = t.select("scenario_id").distinct().select("scenario_id", F.lit(0.1).alias("dt"), F.lit("driver").alias("dataset"))
    path = work_folder(s, "scenes")
    scenes.write_scenes(scenes.scene_view(t, road(s, d), areas(s, d).withColumn("kind", F.lit("drivable_area")), every), path)
    good, _ = scenes.read_scenes(s, path)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    return _rounded(good.select(
        F.col("scenario_id").cast("long").alias("scenario_id"), "planner", F.size("lanes").alias("n_lanes"), F.size("polygons").alias("n_polygons"), F.size("agents").alias("n_agents"), F.size("ego").alias("n_steps"),
        F.size(F.filter("ego_logged", lambda x: x["valid"])).alias("n_valid"), F.element_at("ego", -1)["t"].alias("last_t"), total("ego", lambda x: x["x"]).alias("ego_x"),
        total("agents", lambda a: F.size(a["states"]).cast("double")).alias("agent_states"), total("lanes", lambda a: F.get(F.get(a["centerline"], F.lit(1)), F.lit(1))).alias("middle_y"),
    ))


def r23_cycle_trace(s: SparkSession, d: str) -> DataFrame:
    """Orders as cycles, their lines as candidates (line numbers repeat, so prices tell them, too): the one that is chosen, term by term."""
    c = F.col
    terms = F.create_map(F.lit("progress"), c("l_quantity").cast("double"), F.lit("comfort"), (c("l_discount") * 100).cast("double"), F.lit("lateral"), (c("l_tax") * 100).cast("double"))
    rows = adapters.load(s, d, "lineitem").select(F.floor(c("l_orderkey") / 100).alias("scenario_id"), c("l_orderkey").alias("step"), (c("l_linenumber") * 10**8 + F.round(c("l_extendedprice") * 100).cast("long")).alias("candidate"), (c("l_returnflag") != "R").alias("feasible"), (c("l_extendedprice") / 1000).cast("double").alias("target_v"), c("l_tax").cast("double").alias("target_d"), terms.alias("terms"))
    traced = trace.cycle_trace(rows, {"progress": 0.5, "comfort": 2.0})
    return _rounded(trace.trace_terms(traced).join(traced.select("step", "n_candidates", "n_feasible", "feasible", "target_v", "target_d"), "step"))


QUERIES = {f.__name__: f for f in (i36_scene_view, r23_cycle_trace, r1_lane_graph, r2_routes, r4_reference_paths, r5_frenet, f2_route_features, m6_logged_states, r17_logged_metrics)}

_PLACES = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(PLACES))
_LINKS = ", ".join(f"('{k}', {a}, {b})" for k, a, b in LINKS)
_ROAD = f"""road AS (
  SELECT s_suppkey // 5 AS scenario_id, s_suppkey AS lane_idx, px, py, abs(s_acctbal)::DOUBLE % 2.0 - 1.0 AS off, s_nationkey % 5 <> 4 AS drivable, (s_nationkey % 10 + 1)::DOUBLE AS prior, s_nationkey % 3 = 0 AS crossing, s_nationkey % 4 = 1 AS stop
  FROM supplier JOIN (VALUES {_PLACES}) v(j, px, py) ON j = s_suppkey % 5
), half AS (
  SELECT *, sqrt(20.0 * 20.0 + off * off) AS h FROM road
), many AS (
  SELECT *, floor(2 * h)::BIGINT AS steps FROM half
), sample AS (
  SELECT m.*, i, CASE WHEN 2 * h * i / steps <= h THEN px + 20 * (2 * h * i / steps) / h ELSE px + 20 + 20 * (2 * h * i / steps - h) / h END AS x,
    CASE WHEN 2 * h * i / steps <= h THEN py + off * (2 * h * i / steps) / h ELSE py + off - off * (2 * h * i / steps - h) / h END AS y FROM many m, range(0, steps + 1) r(i)
), turned AS (
  SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS ox, lag(y) OVER w AS oy FROM sample WINDOW w AS (PARTITION BY lane_idx ORDER BY i)
), shaped AS (
  SELECT *, sum(coalesce(sqrt((x - ox) ** 2 + (y - oy) ** 2), 0.0)) OVER (PARTITION BY lane_idx ORDER BY i) AS s, coalesce(atan2(ny - y, nx - x), atan2(y - oy, x - ox)) AS heading,
    2 * ((x - ox) * (ny - oy) - (y - oy) * (nx - ox)) / (sqrt((x - ox) ** 2 + (y - oy) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) * sqrt((nx - ox) ** 2 + (ny - oy) ** 2)) AS curvature FROM turned
), lane AS (
  SELECT scenario_id, lane_idx, any_value(drivable) AS drivable, any_value(prior) AS prior, any_value(crossing) AS crossing, any_value(stop) AS stop, max(s) AS length, count(*) AS n, min_by(heading, i) AS head, max_by(heading, i) AS tail FROM shaped GROUP BY ALL
)"""
_ASKED = """ask AS (
  SELECT user_id // 7 AS scenario_id, user_id AS request_id, min_by(x, step) * 0.6 AS x, min_by(k, step) % 12 / 2 - 1.0 AS y, (min_by(k, step) - 50) * 0.035 AS heading, 50.0 + max_by(x, step) * 0.7 AS gx, (max_by(k, step) % 14 - 2)::DOUBLE AS gy FROM s GROUP BY user_id
)"""
_WRAP = lambda a: f"atan2(sin({a}), cos({a}))"


def _near(x: str, y: str, reach: float) -> str:
    """Each request's nearest place on each drivable lane, if it is within reach: request_id, lane_idx, heading, s, aside, distance, tangent."""
    return f"""SELECT request_id, lane_idx, heading, first(along ORDER BY distance, i) AS s, min(distance) AS distance, first(side * distance ORDER BY distance, i) AS aside, first(tangent ORDER BY distance, i) AS tangent FROM (
    SELECT request_id, lane_idx, heading, i, s + u * sqrt((nx - x) ** 2 + (ny - y) ** 2) AS along, sqrt((px - x - u * (nx - x)) ** 2 + (py - y - u * (ny - y)) ** 2) AS distance, sign((nx - x) * (py - y) - (ny - y) * (px - x)) AS side, tangent FROM (
      SELECT *, greatest(0.0, least(1.0, ((px - x) * (nx - x) + (py - y) * (ny - y)) / ((nx - x) ** 2 + (ny - y) ** 2))) AS u FROM (
        SELECT request_id, lane_idx, ask.heading, {x} AS px, {y} AS py, i, t.x, t.y, nx, ny, s, t.heading AS tangent FROM ask JOIN shaped t ON t.scenario_id = ask.scenario_id AND nx IS NOT NULL AND drivable)))
  GROUP BY ALL HAVING min(distance) <= {reach}"""


_AREA = ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip([AREA[-1], *AREA[:-1]], AREA, strict=True))
_STEP = "0.1::FLOAT::DOUBLE"

ORACLE_SQL = {
    "r1_lane_graph": f"""WITH {_ROAD}, span AS (
  SELECT a.lane_idx, a.x + (b.x - a.x) * (l.length / 2 - a.s) / (b.s - a.s) AS half_x, a.y + (b.y - a.y) * (l.length / 2 - a.s) / (b.s - a.s) AS half_y, a.heading + {_WRAP("b.heading - a.heading")} * (l.length / 2 - a.s) / (b.s - a.s) AS half_heading
  FROM lane l JOIN shaped a ON a.lane_idx = l.lane_idx AND a.s <= l.length / 2 JOIN shaped b ON b.lane_idx = a.lane_idx AND b.i = a.i + 1 AND b.s > l.length / 2
) SELECT t.scenario_id, t.lane_idx, round(max(s), 6) AS length, count(*)::INT AS n_samples, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y, round(max_by(heading, i), 6) AS last_heading, round(coalesce(max(abs(curvature)), 0.0), 4) AS max_curvature,
  round(any_value(half_x), 6) AS half_x, round(any_value(half_y), 6) AS half_y, round(any_value(half_heading), 6) AS half_heading FROM shaped t JOIN span USING (lane_idx) GROUP BY ALL""",
    "r2_routes": f"""WITH RECURSIVE {_STATES}, {_ROAD}, {_ASKED}, begin AS (
  SELECT m.*, lane.length, lane.prior, greatest(0.0, length - s) / greatest(prior, 2.0) + CASE WHEN abs(aside) > 1.75 THEN 4.0 ELSE 0.0 END AS cost FROM ({_near("ask.x", "ask.y", 4.0)}) m JOIN lane USING (lane_idx) WHERE abs({_WRAP("heading - tangent")}) <= pi() / 2
), goal AS ({_near("ask.gx", "ask.gy", 8.0)}
), edge AS (
  SELECT a.lane_idx AS src, b.lane_idx AS dst, kind <> 'succ' AS change, b.length / greatest(b.prior, 2.0) + CASE WHEN kind <> 'succ' THEN 4.0 ELSE 2.0 * abs({_WRAP("b.head - a.tail")}) + CASE WHEN b.stop THEN 2.0 ELSE 0.0 END END + CASE WHEN b.crossing THEN 1.5 ELSE 0.0 END AS cost
  FROM lane a JOIN (VALUES {_LINKS}) v(kind, f, t) ON a.lane_idx % 5 = f JOIN lane b ON b.scenario_id = a.scenario_id AND b.lane_idx % 5 = t AND b.drivable
), way(request_id, lane, cost, path, start_s, first) AS (
  SELECT request_id, lane_idx, cost, [{{'lane': lane_idx, 'change': abs(aside) > 1.75}}], s, lane_idx FROM begin
  UNION ALL SELECT request_id, dst, way.cost + edge.cost, list_append(path, {{'lane': dst, 'change': change}}), start_s, first FROM way JOIN edge ON src = lane WHERE len(list_filter(path, lambda p: p.lane = dst)) = 0
), best AS (
  SELECT way.*, goal.s AS goal_s, row_number() OVER (PARTITION BY way.request_id ORDER BY cost) AS nth FROM way JOIN goal ON goal.request_id = way.request_id AND goal.lane_idx = way.lane
) SELECT scenario_id, request_id,
  CASE WHEN scenario_id NOT IN (SELECT scenario_id FROM lane WHERE drivable) THEN 'no_lanes' WHEN request_id NOT IN (SELECT request_id FROM begin) THEN 'no_start_lane' WHEN request_id NOT IN (SELECT request_id FROM goal) THEN 'no_goal_lane' WHEN nth IS NULL THEN 'unreachable' ELSE 'ok' END AS status,
  round(cost, 5) AS cost, round(start_s, 5) AS start_s, round(goal_s, 5) AS goal_s, array_to_string(list_transform(path, lambda p: CASE WHEN p.change THEN '>' ELSE '' END || p.lane), ' ') AS route
FROM ask LEFT JOIN (SELECT * FROM best WHERE nth = 1) USING (request_id)""",
    "i36_scene_view": f"""WITH {_STATES}, {_ROAD}, t AS (
  SELECT user_id // 7 AS scenario_id, user_id % 7 AS agent_idx, step, x * 1.2 AS x, k % 4 <> CASE WHEN user_id % 7 = 0 THEN 3 ELSE 0 END AS valid FROM s
), e AS (
  SELECT scenario_id, count(*) FILTER (WHERE agent_idx = 0)::INT AS n_steps, count(*) FILTER (WHERE agent_idx = 0 AND valid)::INT AS n_valid, max(step) FILTER (WHERE agent_idx = 0) * 0.1::DOUBLE AS last_t, sum(x) FILTER (WHERE agent_idx = 0) AS ego_x,
    (count(DISTINCT agent_idx) - 1)::INT AS n_agents, count(*) FILTER (WHERE agent_idx > 0)::DOUBLE AS agent_states FROM t GROUP BY scenario_id
), l AS (SELECT scenario_id, count(*)::INT AS n_lanes, sum(py + off) AS middle_y FROM road GROUP BY scenario_id)
SELECT scenario_id, 'none: from the stored log' AS planner, coalesce(n_lanes, 0) AS n_lanes, CASE WHEN scenario_id % 4 < 3 AND n_lanes > 0 THEN 1 ELSE 0 END::INT AS n_polygons, n_agents, n_steps, n_valid, round(last_t, 6) AS last_t, round(ego_x, 6) AS ego_x, agent_states, round(coalesce(middle_y, 0.0), 6) AS middle_y
FROM e LEFT JOIN l USING (scenario_id) WHERE n_steps > 0""",
    "r23_cycle_trace": """WITH c AS (
  SELECT l_orderkey // 100 AS scenario_id, l_orderkey AS step, l_linenumber::BIGINT * 100000000 + round(l_extendedprice * 100)::BIGINT AS candidate, l_returnflag <> 'R' AS feasible, l_extendedprice / 1000 AS target_v, l_tax AS target_d, l_quantity * 0.5 AS a, l_discount * 100 * 2.0 AS b, l_tax * 100 AS c FROM lineitem
), r AS (
  SELECT *, a + b + c AS total, row_number() OVER (PARTITION BY step ORDER BY NOT feasible, round((a + b + c)::DOUBLE, 9), candidate) AS nth, count(*) OVER (PARTITION BY step) AS n_candidates, count(*) FILTER (WHERE feasible) OVER (PARTITION BY step) AS n_feasible FROM c
) SELECT scenario_id, step, candidate AS chosen, round(total::DOUBLE, 6) AS total, unnest(['progress', 'comfort', 'lateral']) AS term, round(unnest([a::DOUBLE, b::DOUBLE, c::DOUBLE]), 6) AS cost, round(unnest([a::DOUBLE, b::DOUBLE, c::DOUBLE]) / total::DOUBLE, 6) AS share,
  n_candidates, n_feasible, feasible, round(target_v::DOUBLE, 6) AS target_v, round(target_d::DOUBLE, 6) AS target_d FROM r WHERE nth = 1""",
    "m6_logged_states": f"""WITH {_STATES}, {_ROAD}, t AS (
  SELECT user_id // 7 AS scenario_id, user_id % 7 AS agent_idx, step, k % 4 <> CASE WHEN user_id % 7 = 0 THEN 3 ELSE 0 END AS valid, ['vehicle', 'pedestrian', 'static', 'bus'][(user_id % 4 + 1)::INT] AS kind, x * 1.2 AS x, (k % 10 - 4)::DOUBLE AS y, heading FROM s
), own AS (
  SELECT *, lag(valid) OVER w AS was, lag(x) OVER w AS bx, lag(y) OVER w AS by_, valid OR step = 0 AS held FROM t WHERE agent_idx = 0 WINDOW w AS (PARTITION BY scenario_id ORDER BY step)
), filled AS (
  SELECT scenario_id, step, last_value(CASE WHEN held THEN x END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN held THEN y END IGNORE NULLS) OVER w AS y, last_value(CASE WHEN held THEN heading END IGNORE NULLS) OVER w AS heading,
    last_value(CASE WHEN step = 0 THEN 12.0 WHEN valid AND was THEN sqrt((x - bx) ** 2 + (y - by_) ** 2) / {_STEP} END IGNORE NULLS) OVER w AS v FROM own WINDOW w AS (PARTITION BY scenario_id ORDER BY step)
), moved AS (
  SELECT *, coalesce((v - lag(v) OVER w) / {_STEP}, 0.0) AS a_lon, coalesce({_WRAP("heading - lag(heading) OVER w")} / {_STEP}, 0.0) AS yaw_rate, lead(step) OVER w AS more FROM filled WINDOW w AS (PARTITION BY scenario_id ORDER BY step)
), ego AS (
  SELECT *, coalesce((lead(a_lon) OVER w - lag(a_lon) OVER w) / (2 * {_STEP}), (lead(a_lon) OVER w - a_lon) / {_STEP}, (a_lon - lag(a_lon) OVER w) / {_STEP}, 0.0) AS jerk FROM moved WHERE more IS NOT NULL WINDOW w AS (PARTITION BY scenario_id ORDER BY step)
), corner AS (
  SELECT scenario_id, step, j, x + cos(heading) * u * 2.4 - sin(heading) * q AS px, y + sin(heading) * u * 2.4 + cos(heading) * q AS py FROM ego, (VALUES (0, 1, 1.0), (1, -1, 1.0), (2, -1, -1.0), (3, 1, -1.0)) k(j, u, q)
), away AS (
  SELECT scenario_id, step, j, sum(((ay > py) <> (zy > py) AND px < ax + (py - ay) * (zx - ax) / nullif(zy - ay, 0))::INT) % 2 = 1 AS inside, min(sqrt((px - ax - u * (zx - ax)) ** 2 + (py - ay - u * (zy - ay)) ** 2)) AS away FROM (
    SELECT *, greatest(0.0, least(1.0, ((px - ax) * (zx - ax) + (py - ay) * (zy - ay)) / ((zx - ax) ** 2 + (zy - ay) ** 2))) AS u FROM corner, (VALUES {_AREA}) e(ax, ay, zx, zy) WHERE scenario_id % 4 < 3 AND scenario_id IN (SELECT s_suppkey // 5 FROM supplier)) GROUP BY ALL
), offroad AS (
  SELECT scenario_id, step, max(CASE WHEN inside THEN 0.0 ELSE away END) AS offroad FROM away GROUP BY ALL
), p AS (
  SELECT {{'scenario_id': g.scenario_id, 'step': g.step, 'heading': g.heading, 'v': g.v, 'x': g.x, 'y': g.y}} AS e, {{'agent_idx': o.agent_idx, 'kind': o.kind, 'heading': o.heading, 'x': o.x, 'y': o.y}} AS o, i, i * {_STEP} AS tau,
    o.x + i * {_STEP} * 12 * cos(o.heading) - g.x - i * {_STEP} * g.v * cos(g.heading) AS dx, o.y + i * {_STEP} * 12 * sin(o.heading) - g.y - i * {_STEP} * g.v * sin(g.heading) AS dy
  FROM ego g JOIN t o ON o.scenario_id = g.scenario_id AND o.step = g.step AND o.agent_idx > 0 AND o.valid, range(0, 30) r(i)
), touching AS (
  SELECT * FROM p WHERE {touch_sql(2.4, 1.0)}
), ttc AS (
  SELECT e.scenario_id AS scenario_id, e.step AS step, min(tau) AS min_ttc FROM touching WHERE i > 0 AND sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2) <= 60 GROUP BY ALL
), hit AS (
  SELECT e.scenario_id AS scenario_id, e.step AS step, min(o.agent_idx)::INT AS collision_agent, min_by(o.kind, o.agent_idx) AS collision_agent_type,
    min_by((o.x - e.x) * cos(e.heading) + (o.y - e.y) * sin(e.heading) <= -0.725 AND 12 * cos(o.heading) * cos(e.heading) + 12 * sin(o.heading) * sin(e.heading) > e.v + 0.5, o.agent_idx) AS ego_struck_from_behind
  FROM touching WHERE i = 0 AND o.kind <> 'static' GROUP BY ALL
), seg AS (
  SELECT scenario_id, lane_idx, 0 AS part, px AS ax, py AS ay, px + 20 AS zx, py + off AS zy FROM road WHERE drivable UNION ALL SELECT scenario_id, lane_idx, 1, px + 20, py + off, px + 40, py FROM road WHERE drivable
), match AS (
  SELECT scenario_id, step, lane_idx, min(away) AS away, abs(first(error ORDER BY away, part)) AS error FROM (
    SELECT *, sqrt((x - ax - u * (zx - ax)) ** 2 + (y - ay - u * (zy - ay)) ** 2) AS away FROM (
      SELECT ego.scenario_id, step, x, y, lane_idx, part, ax, ay, zx, zy, {_WRAP("heading - atan2(zy - ay, zx - ax)")} AS error, greatest(0.0, least(1.0, ((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / ((zx - ax) ** 2 + (zy - ay) ** 2))) AS u FROM ego JOIN seg USING (scenario_id))) GROUP BY ALL
), against AS (SELECT scenario_id, step, min(error) AS heading_error FROM match WHERE away <= 5 GROUP BY ALL)
SELECT scenario_id, step, round(x, 4) AS x, round(y, 4) AS y, round(v, 4) AS v, round(a_lon, 4) AS a_lon, round(abs(yaw_rate), 4) AS yaw_rate, round(jerk, 4) AS jerk, round(offroad, 4) AS offroad, collision_agent, collision_agent_type, ego_struck_from_behind,
  round(min_ttc, 4) AS min_ttc, round(heading_error, 4) AS heading_error FROM ego LEFT JOIN offroad USING (scenario_id, step) LEFT JOIN hit USING (scenario_id, step) LEFT JOIN ttc USING (scenario_id, step) LEFT JOIN against USING (scenario_id, step)""",
}
