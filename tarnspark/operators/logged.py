"""The logged ego as a planner: tracks, lanes, areas and reference paths become the cycles that cycles.scenario_metrics() folds, as one dataflow.

The ego is where its log says; nothing is simulated. All joins are on (scenario_id, step), and points meet lanes and areas by cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.geometry import box_corners, distance, wrap_angle
from tarnspark.operators import lanes as lane_ops
from tarnspark.operators import routes, scene
from tarnspark.sources.work import kept

# The planned vehicle's footprint (m).
EGO_LENGTH, EGO_WIDTH = 4.8, 2.0
STATUSES = ("ok", "load_fail", "no_route", "no_cycles")


def ego_states(tracks: DataFrame, dt: float = scene.STEP) -> DataFrame:
    """The ego's states of tracks (scenario_id, agent_idx 0 the ego, step, valid, x, y, heading, vx, vy), one a step but the last: scenario_id, step, t, x, y, heading, v, a_lon, yaw_rate,
    a_lat, jerk, log_x, log_y.

    At a step that the log lacks the ego stays where it was. Speed is that of the positions, as logged velocities are too noisy; at step 0, and after a
    gap, it is the logged velocity's size or the speed before. a_lon and yaw_rate are of the step before, 0 at first; jerk is their central difference.
    """
    c, key = F.col, "scenario_id"
    w = Window.partitionBy(key).orderBy("step")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = tracks.where("agent_idx = 0").withColumn("own", F.when(c("valid") | (c("step") == 0), F.struct("x", "y", "heading", F.hypot("vx", "vy").alias("v"))))
    d = d.withColumns({"held": F.last("own", ignorenulls=True).over(so_far), "whole": c("valid") & F.lag("valid").over(w), "before": F.lag("own").over(w)})
    moved = F.when(c("step") == 0, c("own.v")).when(c("whole"), distance(c("own.x"), c("own.y"), c("before.x"), c("before.y")) / dt)
    d = d.withColumn("v", F.coalesce(F.last(moved, ignorenulls=True).over(so_far), F.lit(0.0)))
    d = d.select(key, "step", (c("step") * dt).alias("t"), "held.x", "held.y", "held.heading", "v", F.when(c("valid"), c("x")).alias("log_x"), F.when(c("valid"), c("y")).alias("log_y"))
    d = d.withColumns({"a_lon": F.coalesce((c("v") - F.lag("v").over(w)) / dt, F.lit(0.0)), "yaw_rate": F.coalesce(wrap_angle(c("heading") - F.lag("heading").over(w)) / dt, F.lit(0.0)), "more": F.lead("step").over(w)})
    d = d.where("more IS NOT NULL").drop("more").withColumn("a_lat", c("v") * c("yaw_rate"))
    before, after = F.lag("a_lon").over(w), F.lead("a_lon").over(w)
    return d.withColumn("jerk", F.coalesce((after - before) / (2 * dt), (after - c("a_lon")) / dt, (c("a_lon") - before) / dt, F.lit(0.0)))


def off_road(states: DataFrame, areas: DataFrame) -> DataFrame:
    """(scenario_id, step, offroad): how far outside all areas (scenario_id, ring) the worst of the ego's four corners lies; scenarios without areas are left out."""
    c = F.col
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(box_corners(c("x"), c("y"), c("heading"), F.lit(EGO_LENGTH), F.lit(EGO_WIDTH)))]))
    points = states.select("scenario_id", "step", corner.alias("q")).select("scenario_id", F.struct("step", "q.i").alias("point_id"), "q.x", "q.y")
    found = scene.area_distances(points, areas).where("distance IS NOT NULL")
    return found.groupBy("scenario_id", c("point_id.step").alias("step")).agg(F.max("distance").alias("offroad"))


def collisions(states: DataFrame, agents: DataFrame) -> DataFrame:
    """(scenario_id, step, collision_agent, collision_agent_type, ego_struck_from_behind) of the first agent, by index, whose box meets the ego's. agents: valid states of others, with
    kind, vx, vy, length, width."""
    c, key = F.col, ["scenario_id", "step"]
    ego = states.withColumns({"length": F.lit(EGO_LENGTH), "width": F.lit(EGO_WIDTH)})
    hit = scene.overlapping_agents(ego, agents.where(scene.collidable(c("kind"))))
    other = agents.select(*key, "agent_idx", "kind", *[c(a).alias(f"o_{a}") for a in ("x", "y", "vx", "vy")])
    d = hit.join(other, [*key, "agent_idx"]).join(states.select(*key, "x", "y", "heading", "v"), key)
    struck = scene.struck_from_behind(c("x"), c("y"), c("heading"), c("v"), c("o_x"), c("o_y"), c("o_vx"), c("o_vy"))
    return d.select(*key, c("agent_idx").alias("collision_agent"), c("kind").alias("collision_agent_type"), struck.alias("ego_struck_from_behind"))


def logged_cycles(tracks: DataFrame, lanes: DataFrame, areas: DataFrame, paths: DataFrame, run_id: str = "logged_ego", dt: float = scene.STEP) -> DataFrame:
    """The rows that scenario_metrics() takes, of scenarios that have a path (routes.reference_paths). tracks: scenario_id, agent_idx (0 the ego), step, valid, kind, x, y, heading, vx, vy,
    length, width; lanes: as in routes, with points; areas: scenario_id, ring.

    What a replay can't measure is NULL: peaks of kinematics belong to the driver's log, not to a plan, and nothing was planned. The
    kinematics themselves are in ego_states(). The ego's states are kept as a work table, as five joins read them.
    """
    c, key = F.col, ["scenario_id", "step"]
    states = kept(ego_states(tracks, dt).join(paths.select("scenario_id"), "scenario_id", "left_semi"), "ego-states")
    others = tracks.where("agent_idx > 0 AND valid")
    boxed = states.select(*key, "x", "y", "heading", (c("v") * F.cos("heading")).alias("vx"), (c("v") * F.sin("heading")).alias("vy"), F.lit(EGO_LENGTH).alias("length"), F.lit(EGO_WIDTH).alias("width"))
    ttc = scene.time_to_collision(boxed, others.where(scene.collidable(c("kind"))), dt=dt)
    at = states.select("scenario_id", c("step").alias("point_id"), "x", "y", "heading", "v")
    turned = lane_ops.wrong_direction(at, lanes).withColumnRenamed("point_id", "step")
    along = routes.to_frenet(at, paths, ["scenario_id"]).select("scenario_id", c("point_id").alias("step"), "s", "d", "path_length", "speed_prior")
    d = states
    for more in (ttc, turned, along, off_road(states, areas), collisions(states, others)):
        d = d.join(more, key, "left")
    none = {a: F.lit(None).cast("double") for a in ("a_lon", "a_lat", "jerk", "yaw_rate", "plan_us")} | {"refine_converged": F.lit(None).cast("boolean")}
    return d.withColumns(none).withColumn("run_id", F.lit(run_id))


def statuses(tracks: DataFrame, found: DataFrame, paths: DataFrame) -> DataFrame:
    """(scenario_id, status, failure) of every scenario in tracks: load_fail without an ego, no_route without a route (with the search's outcome) or with one too short for a path,
    no_cycles with fewer than two steps, else ok. found: scenario_id, status of the search."""
    c = F.col
    t = tracks.groupBy("scenario_id").agg(F.count_if(c("agent_idx") == 0).alias("n"))
    d = t.join(found.select("scenario_id", c("status").alias("route")), "scenario_id", "left").join(paths.select("scenario_id", F.lit(True).alias("path")), "scenario_id", "left")
    failure = F.when(c("n") == 0, "no_ego").when(F.coalesce("route", F.lit("no_lanes")) != "ok", F.coalesce("route", F.lit("no_lanes"))).when(c("path").isNull(), "empty_reference_path")
    status = F.when(c("n") == 0, "load_fail").when(failure.isNotNull(), "no_route").when(c("n") < 2, "no_cycles").otherwise("ok")
    return d.select("scenario_id", status.alias("status"), failure.alias("failure"))
