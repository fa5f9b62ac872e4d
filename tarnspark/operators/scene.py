"""Scene operators: areas, time to collision, fault, leaders, sight and the features of a scene's first step.

All joins are on the scenario (and step), so a scene's rows meet only each other.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.geometry import box_corners, box_overlap, distance, segment_distance, segments_meet, wrap_angle
from tarnspark.sources.ingest import CITIES

# Bits of what a data set can supply; kinds that nobody can hit.
CAPABILITIES = {"lights": 1, "speed_limits": 2, "stop_signs": 4, "drivable_area": 8, "lane_connectivity": 16}
UNCOLLIDABLE = ("static", "background", "construction")
BOX = ("x", "y", "heading", "length", "width")
# Vehicle classes by the count they belong to.
CLASSES = {"n_vehicles": ("vehicle", "bus"), "n_peds": ("pedestrian",), "n_cyclists": ("cyclist", "motorcyclist")}
# 32-bit 0.1, the step of stored scenes (s); from the ego's rear axle to its centre (m).
STEP = struct.unpack("f", struct.pack("f", 0.1))[0]
AXLE_TO_CENTRE = 1.45


def ring_edges(ring: Column) -> Column:
    """The edges of a ring array<struct<x, y>>, each with the vertex before it; the last vertex closes it."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, (i + n - 1) % n).alias("a"), F.get(ring, i).alias("b")))


def _crosses(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Half-open ray casting: whether the ray from (x, y) to the right meets the edge."""
    return ((ay > y) != (by > y)) & (x < ax + F.try_divide((y - ay) * (bx - ax), by - ay))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """A point on a lower or left edge is inside, on the others outside."""
    return F.size(F.filter(ring_edges(ring), lambda e: _crosses(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))) % 2 == 1


def area_distances(points: DataFrame, polygons: DataFrame, cell: float = 16.0) -> DataFrame:
    """points (scenario_id, point_id, x, y) with inside (of any polygon (scenario_id, ring) of the scenario) and distance, 0 inside; NULL
    where the scenario has no polygon with three vertices.

    Edges are dealt to the rows of cells that they cross, and a point meets those of its row to see whether it is inside. A point outside meets the edges
    that may lie within a cell's size of it, and only one that has none there meets all edges of its scenario.
    """
    c, key = F.col, ["scenario_id", "point_id"]
    rings = polygons.where(F.size("ring") >= 3).select("scenario_id", "ring", F.monotonically_increasing_id().alias("ring_id"))
    e = rings.select("scenario_id", "ring_id", F.explode(ring_edges(c("ring"))).alias("e")).select("scenario_id", "ring_id", *[c(f"e.{a}.{b}").alias(f"{a}{b}") for a in "ab" for b in "xy"])
    ends = (c("ax"), c("ay"), c("bx"), c("by"))
    row = lambda v, reach: F.explode(F.sequence(F.floor((F.least(f"a{v}", f"b{v}") - reach) / cell), F.floor((F.greatest(f"a{v}", f"b{v}") + reach) / cell)))
    p = points.select(*key, "x", "y").withColumns({"cx": F.floor(c("x") / cell), "cy": F.floor(c("y") / cell)})
    crossing = p.join(e.withColumn("cy", row("y", 0.0)), ["scenario_id", "cy"]).where(_crosses(c("x"), c("y"), *ends))
    inside = crossing.groupBy(*key, "ring_id").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").select(*key).distinct().withColumn("inside", F.lit(True))
    d = p.join(rings.select("scenario_id").distinct().withColumn("known", F.lit(True)), "scenario_id", "left").join(inside, key, "left")
    out = d.where("known AND inside IS NULL")
    away = F.min(segment_distance(c("x"), c("y"), *ends))
    near = out.join(e.withColumn("cx", row("x", cell)).withColumn("cy", row("y", cell)), ["scenario_id", "cx", "cy"]).groupBy(*key).agg(away.alias("away")).where(c("away") <= cell)
    far = out.join(near, key, "left_anti").join(e, "scenario_id").groupBy(*key).agg(away.alias("away"))
    d = d.join(near.unionByName(far), key, "left")
    known = lambda v: F.when(c("known"), v)
    return d.select(*key, known(F.coalesce("inside", F.lit(False))).alias("inside"), known(F.when(c("inside"), 0.0).otherwise(c("away"))).alias("distance"))


def time_to_collision(ego: DataFrame, agents: DataFrame, *, dt: float = STEP, horizon: float = 3.0, radius: float = 60.0) -> DataFrame:
    """(scenario_id, step, min_ttc) of each ego state: the first multiple of dt at which its box and an agent's, both at constant
    velocity, touch; NULL if none does. Both: scenario_id, step, x, y, heading, vx, vy, length, width.

    The last step tried is the horizon over dt, cut to a whole number: 29 steps of the 32-bit 0.1 that scenes are stored with, which is
    a little more than 0.1, and 30 of the exact one. The steps are tried inside an array expression, so a pair stays one row.
    """
    a = agents.select("scenario_id", "step", *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "heading", "vx", "vy", "length", "width")])
    c = F.col
    pairs = ego.join(a, ["scenario_id", "step"]).where(distance(c("x"), c("y"), c("o_x"), c("o_y")) <= radius)

    def touch(k: Column) -> Column:
        t = k * dt
        return box_overlap(c("x") + t * c("vx"), c("y") + t * c("vy"), c("heading"), c("length"), c("width"), c("o_x") + t * c("o_vx"), c("o_y") + t * c("o_vy"), c("o_heading"), c("o_length"), c("o_width"))

    first = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(math.trunc(horizon / dt))), touch)) * dt
    found = pairs.groupBy("scenario_id", "step").agg(F.min(first).alias("min_ttc"))
    return ego.select("scenario_id", "step").join(found, ["scenario_id", "step"], "left")


def struck_from_behind(ex: Column, ey: Column, heading: Column, ev: Column, ox: Column, oy: Column, ovx: Column, ovy: Column) -> Column:
    """Whether the other is behind the ego's centre and faster along the ego's heading, so the ego is not at fault."""
    along = (ox - ex) * F.cos(heading) + (oy - ey) * F.sin(heading)
    return (along <= -0.5 * AXLE_TO_CENTRE) & (ovx * F.cos(heading) + ovy * F.sin(heading) > ev + 0.5)


def maneuver(first_heading: Column, last_heading: Column, lane_changes: Column) -> Column:
    turn = wrap_angle(last_heading - first_heading) * 180 / math.pi
    straight = F.when(lane_changes > 0, "lane_change").otherwise("straight")
    return F.when(F.abs(turn) > 150, "uturn").when(turn > 35, "left").when(turn < -35, "right").otherwise(straight)


def speed_regime(mean_speed: Column) -> Column:
    return F.when(mean_speed < 1, "stopped").when(mean_speed < 5, "low").when(mean_speed < 11, "mid").when(mean_speed.isNotNull(), "high")


def first_step_features(ego: DataFrame, agents: DataFrame) -> DataFrame:
    """Counts and distances of a scenario's other agents. ego: scenario_id, x, y, heading at step 0; agents: the others' states, scenario_id,
    agent_idx, step, valid, kind, x, y, heading. An agent counts if it is valid at any step; distances, headings and
    the gap are of agents valid at step 0. A scenario without agents has counts of 0 and NULL distances."""
    c = F.col
    at0 = (c("step") == 0) & c("valid")
    first = F.max(F.when(at0, F.struct(*[c(x).alias(f"o_{x}") for x in ("x", "y", "heading")])))
    a = agents.groupBy("scenario_id", "agent_idx").agg(F.max("valid").alias("ever"), F.first("kind").alias("kind"), first.alias("o")).where("ever").select("scenario_id", "agent_idx", "kind", "o.*")
    dx, dy = c("o_x") - c("x"), c("o_y") - c("y")
    away = distance(c("x"), c("y"), c("o_x"), c("o_y"))
    turn = F.abs(wrap_angle(c("o_heading") - c("heading")))
    along, aside = dx * F.cos("heading") + dy * F.sin("heading"), dy * F.cos("heading") - dx * F.sin("heading")
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return ego.select("scenario_id", "x", "y", "heading").join(a, "scenario_id", "left").groupBy("scenario_id").agg(
        F.count("agent_idx").alias("n_agents"), *[count(c("kind").isin(*kinds)).alias(name) for name, kinds in CLASSES.items()],
        count(away <= 30).alias("n_agents_within_30m"), F.min(away).alias("min_agent_dist_t0"),
        count((away <= 40) & (turn > 2 * math.pi / 3)).alias("n_oncoming_within_40m"), count((away <= 40) & (turn > math.pi / 3) & (turn <= 2 * math.pi / 3)).alias("n_crossing_within_40m"),
        F.min(F.when((along > 0) & (along <= 60) & (F.abs(aside) <= 2), along)).alias("lead_agent_gap"),
    )


def agent_density(within_30m: Column, route_len_m: Column) -> Column:
    """Agents within 30 m for each 100 m of the route; 0 for routes of up to 1 m."""
    return F.when(route_len_m > 1, within_30m * 100.0 / route_len_m).otherwise(0.0)


def leaders(states: DataFrame, max_along: float = 60.0, max_aside: float = 2.2) -> DataFrame:
    """Each state's leader: scenario_id, step, agent_idx, leader_idx, gap. states: scenario_id, step, agent_idx, x, y, heading. The leader is the nearest
    agent ahead along the heading and close to it sideways, of equally near ones that of the smaller index; without one both are NULL."""
    o = states.select("scenario_id", "step", *[F.col(c).alias(f"o_{c}") for c in ("agent_idx", "x", "y")])
    c = F.col
    dx, dy = c("o_x") - c("x"), c("o_y") - c("y")
    d = states.join(o, ["scenario_id", "step"]).where("agent_idx <> o_agent_idx").withColumns({"along": dx * F.cos("heading") + dy * F.sin("heading"), "aside": dy * F.cos("heading") - dx * F.sin("heading")})
    d = d.where((c("along") > 0) & (c("along") <= max_along) & (F.abs("aside") <= max_aside)).groupBy("scenario_id", "step", "agent_idx").agg(F.min(F.struct("along", "o_agent_idx")).alias("m"))
    key = ["scenario_id", "step", "agent_idx"]
    return states.select(*key).join(d.select(*key, c("m.o_agent_idx").alias("leader_idx"), c("m.along").alias("gap")), key, "left")


def closest_agents(ego: DataFrame, agents: DataFrame, k: int = 1, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The k agents that come closest to the ego over the steps both are valid at: scenario_id, agent_idx, min_distance, rank. Valid states only:
    ego (scenario_id, step, x, y), agents (scenario_id, step, agent_idx, x, y, kind)."""
    a = agents if kinds is None else agents.where(F.col("kind").isin(*kinds))
    a = a.select("scenario_id", "step", "agent_idx", F.col("x").alias("o_x"), F.col("y").alias("o_y"))
    c = F.col
    d = ego.select("scenario_id", "step", "x", "y").join(a, ["scenario_id", "step"]).groupBy("scenario_id", "agent_idx").agg(F.min(distance(c("x"), c("y"), c("o_x"), c("o_y"))).alias("min_distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("scenario_id").orderBy("min_distance", "agent_idx"))).where(c("rank") <= k)


def overlapping_agents(ego: DataFrame, agents: DataFrame) -> DataFrame:
    """(scenario_id, step, agent_idx): the first agent, by index, whose box touches the ego's; steps without one are left out. Both:
    scenario_id, step, x, y, heading, length, width; agents also agent_idx. Kinds that nobody can hit are the caller's to leave out (collidable())."""
    a = agents.select("scenario_id", "step", "agent_idx", *[F.col(c).alias(f"o_{c}") for c in BOX])
    c = F.col
    hit = box_overlap(*[c(x) for x in BOX], *[c(f"o_{x}") for x in BOX])
    return ego.select("scenario_id", "step", *BOX).join(a, ["scenario_id", "step"]).where(hit).groupBy("scenario_id", "step").agg(F.min("agent_idx").alias("agent_idx"))


def collidable(kind: Column) -> Column:
    return ~kind.isin(*UNCOLLIDABLE)


def occlusion(ego: DataFrame, agents: DataFrame, radius: float = 50.0) -> DataFrame:
    """(scenario_id, n_considered, n_occluded, occluded_agent_frac) at one step: the share of agents within radius whose line of sight from the ego meets
    an edge of a nearer agent's box; 0 without any. ego: scenario_id, x, y; agents: scenario_id, agent_idx, x, y, heading, length, width."""
    c = F.col
    far = distance(c("ex"), c("ey"), c("x"), c("y"))
    e = ego.select("scenario_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    a = e.join(agents, "scenario_id").withColumn("far", far)
    b = a.select("scenario_id", F.col("agent_idx").alias("j"), F.col("far").alias("j_far"), *[F.col(x).alias(f"j_{x}") for x in BOX])
    corners = box_corners(*[c(f"j_{x}") for x in BOX])
    meets = F.lit(False)
    for (px, py), (qx, qy) in zip(corners, [*corners[1:], corners[0]], strict=True):
        meets = meets | segments_meet(c("ex"), c("ey"), c("x"), c("y"), px, py, qx, qy)
    seen = a.where(c("far") <= radius)
    hidden = seen.join(b, "scenario_id").where((c("j") != c("agent_idx")) & (c("j_far") < c("far"))).where(meets).select("scenario_id", "agent_idx").distinct().withColumn("hidden", F.lit(1))
    d = ego.select("scenario_id").join(seen.select("scenario_id", "agent_idx").join(hidden, ["scenario_id", "agent_idx"], "left"), "scenario_id", "left")
    d = d.groupBy("scenario_id").agg(F.count("agent_idx").alias("n_considered"), F.count("hidden").alias("n_occluded"))
    return d.withColumn("occluded_agent_frac", F.coalesce(F.try_divide("n_occluded", "n_considered"), F.lit(0.0)))


def crosswalk_on_route(paths: DataFrame, crosswalks: DataFrame, reach: float = 6.0, every: int = 8) -> DataFrame:
    """(scenario_id, has_crosswalk_on_route): 1 if a vertex of a crosswalk lies within reach of every eighth point of the path, else 0, never NULL.
    paths: scenario_id, points array; crosswalks: scenario_id, ring array."""
    c = F.col
    p = paths.select("scenario_id", F.posexplode("points").alias("i", "p")).where(c("i") % every == 0).select("scenario_id", c("p.x").alias("x"), c("p.y").alias("y"), F.floor(c("p.x") / reach).alias("cx"), F.floor(c("p.y") / reach).alias("cy"))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    v = crosswalks.select("scenario_id", F.explode("ring").alias("v")).select("scenario_id", c("v.x").alias("vx"), c("v.y").alias("vy")).withColumn("i", near).withColumn("j", near)
    v = v.withColumns({"cx": F.floor(c("vx") / reach) + c("i"), "cy": F.floor(c("vy") / reach) + c("j")})
    close = (c("x") - c("vx")) * (c("x") - c("vx")) + (c("y") - c("vy")) * (c("y") - c("vy")) < reach * reach
    found = p.join(v, ["scenario_id", "cx", "cy"]).where(close).select("scenario_id").distinct().withColumn("has_crosswalk_on_route", F.lit(1))
    return paths.select("scenario_id").join(found, "scenario_id", "left").select("scenario_id", F.coalesce("has_crosswalk_on_route", F.lit(0)).alias("has_crosswalk_on_route"))


def gated(capabilities: Column, name: str, value: Column) -> Column:
    """value where the data set can supply it, by its capability bits, else NULL, whatever the column holds."""
    return F.when(capabilities.bitwiseAND(F.lit(CAPABILITIES[name])) != 0, value)


def signal_features(capabilities: Column, n_lights: Column, stop_sign_on_route: Column) -> dict[str, Column]:
    return {
        "has_traffic_light": gated(capabilities, "lights", (n_lights > 0).cast("int")), "light_state_t0": gated(capabilities, "lights", F.lit("unknown")),
        "has_stop_sign": gated(capabilities, "stop_signs", stop_sign_on_route.cast("int")),
    }


def city_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, CITIES)), code), F.lit("unknown"))


def outcome_margins(outcomes: DataFrame, nominal: float = 0.0) -> DataFrame:
    """How far from nominal an outcome flips: per scenario n, n_failed, kind (never, always, flips) and margin, the least distance from nominal of a value whose
    outcome differs from the nominal one's; NULL if none does. outcomes: scenario_id, value, failed (0 or 1)."""
    away = F.abs(F.col("value") - nominal)
    base = outcomes.where(F.col("value") == nominal).groupBy("scenario_id").agg(F.max("failed").alias("base"))
    d = outcomes.join(base, "scenario_id", "left").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").cast("long").alias("n_failed"), F.min(F.when(F.col("failed") != F.col("base"), away)).alias("margin"))
    kind = F.when(F.col("n_failed") == 0, "never").when(F.col("n_failed") == F.col("n"), "always").otherwise("flips")
    return d.select("scenario_id", "n", "n_failed", kind.alias("kind"), "margin")


def status_percentiles(routes: DataFrame, value: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per status: n and the values at the floor of q (n - 1) of the sorted ones (no interpolation)."""
    n = F.count(value).over(Window.partitionBy("status"))
    at = F.row_number().over(Window.partitionBy("status").orderBy(value)) - 1
    d = routes.where(F.col(value).isNotNull()).select("status", value, n.alias("n"), at.alias("at"))
    return d.groupBy("status").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("at") == F.floor(q * (F.col("n") - 1)), F.col(value))).alias(f"p{round(q * 100)}") for q in quantiles])


def ego_speed_features(states: DataFrame) -> DataFrame:
    """Of each scenario in states (scenario_id, step, v: the ego's speed, NULL where its sample is not valid): the speed at step 0, 0 if that sample is not
    valid or not there, and mean, highest speed and number of slow samples of the valid ones, 0 without any."""
    or_0 = lambda c: F.coalesce(c, F.lit(0.0))
    d = states.groupBy("scenario_id").agg(
        or_0(F.max(F.when(F.col("step") == 0, F.col("v")))).alias("ego_speed_t0"), or_0(F.avg("v")).alias("ego_mean_speed"), or_0(F.max("v")).alias("ego_max_speed"), F.count_if(F.col("v") < 0.5).alias("ego_stops")
    )
    return d.withColumn("speed_regime", speed_regime(F.col("ego_mean_speed")))
