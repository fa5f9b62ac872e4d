"""Routes: the lane graph, cheapest routes over it, reference paths along them, and coordinates along a path.

A lane is a row (scenario_id, lane_idx, points array<struct<x, y>>, lane_type, speed_prior, is_intersection, has_stop_sign). Polylines are resampled
and differentiated as rows, in windows over one shuffle by lane or route; a scenario's edges meet its requests in one row, bounded
by the limits of stored scenes (ingest.MAX_LANES), and a heap in the task finds the route.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.functions.geometry import curvature, distance, lerp_angle, wrap_angle
from tarnspark.operators.lanes import DRIVABLE, lane_matches, shuffled, smoothed

# Spacing of a lane's samples (m) and the most it may have; lengths that count as none.
SPACING, MAX_SAMPLES, EPS = 1.0, 1 << 16, 1e-9
# Costs in seconds of a lane change, a radian of turn at a junction, entering an intersection, a stop sign; least speed of an estimate (m/s).
LANE_CHANGE, TURN_PER_RAD, INTERSECTION, STOP_SIGN, LEAST_SPEED = 4.0, 2.0, 1.5, 2.0, 2.0
# Reach of a start and its turn, reach of a goal (m, rad, m); half a lane's width, beyond which a start lane is a neighbour.
START_LATERAL, START_TURN, GOAL_LATERAL, HALF_LANE = 4.0, math.pi / 2, 8.0, 1.75
# Outcomes of a search, in the order in which they are looked for.
OUTCOMES = ("no_lanes", "no_start_lane", "no_goal_lane", "unreachable", "ok")
# Fixed values of reference paths: spacing (m), length of a lane change (m), smoothing passes, most samples, run-up before the start (m), reach of the lane that is left (m), least gap between points (m).
PATH_STEP, CHANGE_LENGTH, PASSES, MAX_PATH, RUN_UP, LEFT_REACH, LEAST_GAP = 0.5, 25.0, 2, 1 << 18, 2.0, 12.0, 0.05
#: Distances that a task holds at a time when it looks for nearest samples.
CELLS = 1 << 20
ROUTE = "array<struct<lane_idx: bigint, lane_change: boolean>>"


def evenly(points: DataFrame, keys: list[str], spacing: float, most: int, *, whole: bool, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Polylines (keys, i, x, y, attributes) resampled by arc length: keys, i from 0, x, y, attributes of the nearer point. whole: both ends are samples, two at least,
    and the spacing is stretched to fit; else samples lie at multiples of the spacing. Polylines without length are left out; one of more than `most`
    samples raises.

    A segment makes the samples whose place lies beyond its start and not beyond its end; that of a segment's end is computed alike
    for both neighbours, so no sample is made twice or lost.
    """
    c, w = F.col, Window.partitionBy(*keys).orderBy("i")
    d = points.withColumns({f"next_{a}": F.lead(a).over(w) for a in ("x", "y", *attributes)}).where("next_x IS NOT NULL")
    d = d.withColumn("size", distance(c("x"), c("y"), c("next_x"), c("next_y"))).where(c("size") > EPS)
    every = Window.partitionBy(*keys)
    d = d.withColumns({"end": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "start": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "last": F.max("i").over(every), "first": F.min("i").over(every)})
    d = d.withColumn("total", F.max("end").over(every))
    n = F.floor(c("total") / spacing) + 1
    n = F.when(n > most, F.raise_error(F.format_string(f"a polyline of %s m has over {most} samples", c("total").cast("string"))).cast("long")).otherwise(F.greatest(n, F.lit(2)) if whole else n)
    d = d.withColumn("n", n)
    place = lambda at: F.floor(at * (c("n") - 1) / c("total") if whole else at / spacing)
    low = F.when(c("i") == c("first"), F.lit(0)).otherwise(place(c("start")) + 1)
    high = F.when(c("i") == c("last"), c("n") - 1).otherwise(place(c("end")))
    d = d.withColumn("k", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))))
    target = c("total") * c("k") / (c("n") - 1) if whole else F.least(c("total"), c("k") * spacing)
    # Rounding decides between two segments beyond a bend: a place is taken as in the SQL, multiplied before it is divided.
    d = d.withColumn("along", F.greatest(F.lit(0.0), F.least(c("size"), target - c("start"))))
    return d.select(*keys, c("k").alias("i"), *[(c(a) + (c(f"next_{a}") - c(a)) * c("along") / c("size")).alias(a) for a in ("x", "y")], *[F.when(c("along") / c("size") < 0.5, c(a)).otherwise(c(f"next_{a}")).alias(a) for a in attributes])


def differentiated(points: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, i, x, y, ...) with s (arc length so far), heading (of the step that follows, at the end of the one before) and curvature (of three
    neighbours; both ends copy theirs, and two points have none)."""
    c, w = F.col, Window.partitionBy(*keys).orderBy("i")
    at = lambda k: (F.lag("x", -k).over(w), F.lag("y", -k).over(w)) if k < 0 else (F.lead("x", k).over(w), F.lead("y", k).over(w)) if k else (c("x"), c("y"))
    step = F.coalesce(distance(*at(-1), *at(0)), F.lit(0.0))
    turn = lambda a, b: F.atan2(b[1] - a[1], b[0] - a[0])
    bend = lambda k: F.when(at(k - 1)[0].isNotNull() & at(k + 1)[0].isNotNull(), curvature(*at(k - 1), *at(k), *at(k + 1)))
    d = points.withColumns({"step": step, "heading": F.coalesce(turn(at(0), at(1)), turn(at(-1), at(0))), "curvature": F.coalesce(bend(0), F.when(at(-1)[0].isNull(), bend(1)), F.when(at(1)[0].isNull(), bend(-1)), F.lit(0.0))})
    return d.withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def lane_graph(lanes: DataFrame, spacing: float = SPACING) -> DataFrame:
    """lanes with length and samples, array<struct<i, s, x, y, heading, curvature>>, in the place of points. Lanes without length are left out; one of over MAX_SAMPLES
    samples raises."""
    key = ["scenario_id", "lane_idx"]
    points = lanes.select(*key, F.posexplode("points").alias("i", "p")).select(*key, "i", "p.x", "p.y")
    d = differentiated(evenly(points, key, spacing, MAX_SAMPLES, whole=True), key)
    d = d.groupBy(*key).agg(F.max("s").alias("length"), F.array_sort(F.collect_list(F.struct("i", "s", "x", "y", "heading", "curvature"))).alias("samples"))
    return lanes.drop("points").join(d, key)


def lane_pose(samples: Column, s: Column) -> tuple[Column, Column, Column]:
    """(x, y, heading) at arc length s of a lane's samples, held at its ends."""
    n = F.size(samples)
    at = F.greatest(F.lit(0.0), F.least(s, F.get(samples, n - 1)["s"]))
    # Samples are evenly spaced but for rounding, so the one after s is found by counting those up to it.
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(samples, lambda p: p["s"] <= at))))
    a, b = F.get(samples, i - 1), F.get(samples, i)
    t = F.coalesce(F.try_divide(at - a["s"], b["s"] - a["s"]), F.lit(0.0))
    return a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t, lerp_angle(a["heading"], b["heading"], t)


def travel_time(length: Column, speed: Column) -> Column:
    return length / F.greatest(speed, F.lit(LEAST_SPEED))


def edge_costs(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """(scenario_id, src, dst, cost, lane_change) of edges (scenario_id, src, dst, kind: succ, left or right) to drivable lanes, in seconds: the time on the lane that is entered, and
    what turns, intersections, stop signs and lane changes add."""
    c = F.col
    to = graph.where(c("lane_type") == DRIVABLE).select("scenario_id", c("lane_idx").alias("dst"), travel_time(c("length"), c("speed_prior")).alias("time"), F.get("samples", F.lit(0))["heading"].alias("head"), "is_intersection", "has_stop_sign")
    tail = graph.select("scenario_id", c("lane_idx").alias("src"), F.element_at("samples", -1)["heading"].alias("tail"))
    d = edges.where(c("kind").isin("succ", "left", "right")).join(to, ["scenario_id", "dst"]).join(tail, ["scenario_id", "src"])
    change, extra = c("kind") != "succ", lambda flag, cost: F.when(c(flag), cost).otherwise(0.0)
    ahead = TURN_PER_RAD * F.abs(wrap_angle(c("head") - c("tail"))) + extra("has_stop_sign", STOP_SIGN)
    cost = c("time") + F.when(change, F.lit(LANE_CHANGE)).otherwise(ahead) + extra("is_intersection", INTERSECTION)
    return d.select("scenario_id", "src", "dst", cost.alias("cost"), change.alias("lane_change"))


def cheapest(edges: Iterable, starts: Iterable, goals: set[int]) -> tuple[float, list[tuple[int, bool]]] | None:
    """(cost, lanes with whether each is entered by a lane change) of the cheapest way from a start to a goal; of equal costs the one that was reached
    first, in order of cost and lane. A node is the far end of a lane, and costs are not negative. None if no goal is reached."""
    out = defaultdict(list)
    for e in edges:
        out[e["src"]].append((e["dst"], e["cost"], bool(e["lane_change"])))
    cost: dict[int, float] = {}
    came: dict[int, tuple[int | None, bool]] = {}
    heap: list[tuple[float, int]] = []

    def relax(lane: int, total: float, came_from: int | None, change: bool) -> None:
        if total + EPS < cost.get(lane, math.inf):
            cost[lane], came[lane] = total, (came_from, change)
            heapq.heappush(heap, (total, lane))

    for s in starts:
        relax(s["lane_idx"], s["cost"], None, bool(s["lane_change"]))
    while heap:
        total, lane = heapq.heappop(heap)
        if total > cost[lane] + EPS:
            continue
        if lane in goals:
            way, at = [], lane
            while at is not None:
                way.append((at, came[at][1]))
                at = came[at][0]
            return total, way[::-1]
        for to, more, change in out[lane]:
            relax(to, total + more, lane, change)
    return None


def find_routes(graph: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request's route: scenario_id, request_id, status (OUTCOMES), cost (s), start_s, goal_s (arc lengths on the first and the last lane) and route, array<struct<lane_idx, lane_change>>;
    all but the status are NULL where there is none. requests: scenario_id, request_id, x, y, heading, goal_x, goal_y; graph: lane_graph's rows.

    A start is every drivable lane within START_LATERAL and START_TURN of the pose, at the cost of the rest of the lane, and of a lane change where the
    pose is not in it; a goal every drivable lane within GOAL_LATERAL of the goal.
    """
    c, key = F.col, ["scenario_id", "request_id"]
    polylines = graph.select("scenario_id", "lane_idx", "lane_type", F.transform("samples", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    at = requests.withColumnRenamed("request_id", "point_id")
    starts = lane_matches(at, polylines, START_LATERAL, START_TURN, drivable=True)
    goals = lane_matches(at.select("scenario_id", "point_id", c("goal_x").alias("x"), c("goal_y").alias("y")), polylines, GOAL_LATERAL, drivable=True)
    own = graph.select("scenario_id", "lane_idx", "length", "speed_prior")
    change = F.abs("lateral") > HALF_LANE
    begin = travel_time(F.greatest(F.lit(0.0), c("length") - c("s")), c("speed_prior")) + F.when(change, LANE_CHANGE).otherwise(0.0)
    starts = starts.join(own, ["scenario_id", "lane_idx"]).groupBy("scenario_id", c("point_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("rank", c("lane_idx").cast("long").alias("lane_idx"), begin.alias("cost"), "s", change.alias("lane_change")))).alias("starts"))
    goals = goals.groupBy("scenario_id", c("point_id").alias("request_id")).agg(F.collect_list(F.struct(c("lane_idx").cast("long").alias("lane_idx"), "s")).alias("goals"))
    ways = edge_costs(graph, edges).groupBy("scenario_id").agg(F.collect_list(F.struct(c("src").cast("long").alias("src"), c("dst").cast("long").alias("dst"), "cost", "lane_change")).alias("ways"))
    drivable = graph.where(c("lane_type") == DRIVABLE).select("scenario_id").distinct().withColumn("drivable", F.lit(True))
    d = requests.select(*key).join(starts, key, "left").join(goals, key, "left").join(ways, "scenario_id", "left").join(drivable, "scenario_id", "left")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for scenario, request, starts, goals, ways, drivable in zip(b["scenario_id"], b["request_id"], b["starts"], b["goals"], b["ways"], b["drivable"], strict=True):
                lacks = next((o for o, x in zip(OUTCOMES, (drivable, starts, goals), strict=False) if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x))), None)
                found = None if lacks else cheapest(ways if ways is not None else (), starts, {g["lane_idx"] for g in goals})
                if found is None:
                    rows.append((scenario, request, lacks or "unreachable", None, None, None, None))
                    continue
                cost, way = found
                on = lambda side, lane: next(x["s"] for x in side if x["lane_idx"] == lane)
                rows.append((scenario, request, "ok", cost, on(starts, way[0][0]), on(goals, way[-1][0]), [{"lane_idx": lane, "lane_change": changed} for lane, changed in way]))
            yield pd.DataFrame(rows, columns=["scenario_id", "request_id", "status", "cost", "start_s", "goal_s", "route"])

    kinds = dict(requests.dtypes)
    return d.mapInPandas(search, f"scenario_id {kinds['scenario_id']}, request_id {kinds['request_id']}, status string, cost double, start_s double, goal_s double, route {ROUTE}")


def smoothstep(t: Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x * x * (3.0 - 2.0 * x)


def nearest_on(samples: Column, x: Column, y: Column) -> Column:
    """struct<distance, i, x, y>: the point of a polyline that is nearest to (x, y), the first of equally near ones, and its segment."""

    def on(i: Column) -> Column:
        a, b = F.get(samples, i), F.get(samples, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        px, py = a["x"] + dx * t, a["y"] + dy * t
        return F.struct(distance(x, y, px, py).alias("distance"), i.alias("i"), px.alias("x"), py.alias("y"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(samples) - 2), on))


def reference_paths(routes: DataFrame, graph: DataFrame, step: float = PATH_STEP) -> DataFrame:
    """(scenario_id, request_id, length, path array<struct<i, s, x, y, heading, curvature, speed_prior, lane_idx, is_intersection>>) of the routes that are ok.

    The lanes' samples follow each other, from RUN_UP before the start on; over a lane change a point is blended from the lane that is left; points closer
    than LEAST_GAP to the one before are dropped; the rest is smoothed, resampled at even steps and differentiated, and the curvature is
    smoothed once. A route whose path is shorter than two steps is left out.
    """
    c, key = F.col, ["scenario_id", "request_id"]
    hops = F.transform("route", lambda h, k: F.struct(k.alias("k"), h["lane_idx"].alias("lane_idx"), F.when(h["lane_change"] & (k > 0), F.get("route", k - 1)["lane_idx"]).alias("before")))
    r = routes.where("status = 'ok'").select(*key, "start_s", F.explode(hops).alias("h")).select(*key, "start_s", "h.*")
    r = r.join(shuffled(graph.select("scenario_id", "lane_idx", "samples", "speed_prior", "is_intersection")), ["scenario_id", "lane_idx"])
    r = r.join(shuffled(graph.select("scenario_id", c("lane_idx").alias("before"), c("samples").alias("left"))), ["scenario_id", "before"], "left")
    since = F.when(c("k") == 0, F.greatest(F.lit(0.0), c("start_s") - RUN_UP)).otherwise(0.0)
    ahead = F.filter("samples", lambda p: p["s"] >= since)
    near = F.transform(ahead, lambda p: F.struct(p["i"].alias("j"), p["s"].alias("s"), p["x"].alias("x"), p["y"].alias("y"), F.when(c("left").isNotNull(), nearest_on(c("left"), p["x"], p["y"])).alias("from")))

    def blended(p: Column) -> Column:
        w = F.when(p["from"]["distance"] < LEFT_REACH, smoothstep(p["s"] / max(CHANGE_LENGTH, 1.0))).otherwise(1.0)
        mix = lambda a: F.coalesce(p["from"][a] * (1.0 - w) + p[a] * w, p[a]).alias(a)
        return F.struct(p["j"].alias("j"), mix("x"), mix("y"))

    r = r.withColumn("near", near).select(*key, "k", "lane_idx", "speed_prior", "is_intersection", F.explode(F.transform("near", blended)).alias("p"))
    point = F.struct("k", c("p.j").alias("j"), c("p.x").alias("x"), c("p.y").alias("y"), c("lane_idx").cast("long").alias("lane_idx"), c("speed_prior").cast("double").alias("speed_prior"), "is_intersection")
    g = r.groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("raw"))
    kind = "array<struct<k:int,j:bigint,x:double,y:double,lane_idx:bigint,speed_prior:double,is_intersection:boolean>>"
    last = lambda acc: F.element_at(acc, -1)
    kept = F.aggregate(c("raw").cast(kind), F.array().cast(kind), lambda acc, p: F.when(F.size(acc) == 0, F.array(p).cast(kind)).when(distance(last(acc)["x"], last(acc)["y"], p["x"], p["y"]) < LEAST_GAP, acc).otherwise(F.array_append(acc, p).cast(kind)))
    g = g.select(*key, kept.alias("raw")).where(F.size("raw") >= 2)
    points = g.select(*key, F.posexplode("raw").alias("i", "p")).select(*key, "i", "p.*")
    for a in ("x", "y"):
        points = smoothed(points, key, "i", a, PASSES)
    d = differentiated(evenly(points, key, step, MAX_PATH, whole=False, attributes=("lane_idx", "speed_prior", "is_intersection")), key)
    w = Window.partitionBy(*key).orderBy("i")
    before, after = F.lag("curvature").over(w), F.lead("curvature").over(w)
    d = d.withColumn("curvature", F.coalesce(0.25 * before + 0.5 * c("curvature") + 0.25 * after, c("curvature")))
    sample = F.struct("i", (c("i") * step).alias("s"), *["x", "y", "heading", "curvature", "speed_prior", "lane_idx", "is_intersection"])
    out = d.groupBy(*key).agg((F.max("i") * step).alias("length"), F.array_sort(F.collect_list(sample)).alias("path"))
    return out.where(F.size("path") >= 3)


def path_pose(path: Column, s: Column, step: float = PATH_STEP) -> Column:
    """struct<x, y, heading, i> at arc length s of a path, held at its ends; as samples are even, a division finds the one before s."""
    n = F.size(path)
    at = F.greatest(F.lit(0.0), F.least(s, (n - 1) * F.lit(step)))
    i = F.least(F.floor(at / step).cast("int"), n - 1)
    a, b = F.get(path, i), F.get(path, F.least(i + 1, n - 1))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - i * step) / step))
    return F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"), lerp_angle(a["heading"], b["heading"], t).alias("heading"), i.alias("i"))


def to_cartesian(path: Column, s: Column, d: Column, step: float = PATH_STEP) -> Column:
    """struct<x, y>: the place at arc length s of a path and d to the left of it."""
    p = path_pose(path, s, step)
    return F.struct((p["x"] - F.sin(p["heading"]) * d).alias("x"), (p["y"] + F.cos(p["heading"]) * d).alias("y"))


def wrapped(a: np.ndarray) -> np.ndarray:
    """geometry.wrap_angle of an array."""
    r = np.fmod(a, 2 * np.pi)
    return np.where(r > np.pi, r - 2 * np.pi, np.where(r <= -np.pi, r + 2 * np.pi, r))


def nearest_samples(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """Index of the sample (qx, qy) that is nearest to each point (x, y), the first of equally near ones; at most CELLS distances are held at a time."""
    rows = max(1, CELLS // len(qx))
    square = lambda i: (x[i : i + rows, None] - qx) ** 2 + (y[i : i + rows, None] - qy) ** 2
    return np.concatenate([square(i).argmin(axis=1) for i in range(0, len(x), rows)])


def along_path(x: np.ndarray, y: np.ndarray, k: np.ndarray, path: tuple[np.ndarray, ...], first: np.ndarray, n: np.ndarray, step: float) -> tuple[np.ndarray, ...]:  # noqa: PLR0913
    """(distance, s, d) of points from segment k of their path, which is n samples of `path` (x and y) from `first` on; the distance is infinite where the path has no such segment or
    its length is none."""
    qx, qy = path
    j = first + np.clip(k, 0, n - 2)
    ux, uy = qx[j + 1] - qx[j], qy[j + 1] - qy[j]
    size = ux * ux + uy * uy
    t = np.clip(((x - qx[j]) * ux + (y - qy[j]) * uy) / size, 0.0, 1.0)
    gx, gy = x - qx[j] - ux * t, y - qy[j] - uy * t
    away = np.where((k >= 0) & (k + 1 < n) & (size > EPS), np.sqrt(gx * gx + gy * gy), np.inf)
    return away, (k + t) * step, (gy * ux - gx * uy) / np.sqrt(size)


def to_frenet(points: DataFrame, paths: DataFrame, keys: list[str], step: float = PATH_STEP) -> DataFrame:
    """points (keys, point_id, x, y, heading, v) along their path (keys, path): keys, point_id, s, d (left is positive), ds, dd (speeds along and across), path_length, and speed_prior, lane_idx
    and is_intersection of the sample before s. Points without a path of two samples are left out; a point whose place is NULL or not finite stays, with NULLs, and without
    heading or v only its speeds are NULL.

    The nearest sample is found first, then the nearest place on the two segments that meet there. A partition's points of a path come to it as one
    array, so the path is not copied for each of them, and no array holds more of a path's points than one partition had.
    """
    c = F.col
    pack = F.collect_list(F.struct("point_id", *[c(a).cast("double").alias(a) for a in ("x", "y", "heading", "v")])).alias("_points")
    packs = points.withColumn("_part", F.spark_partition_id()).groupBy(*keys, "_part").agg(pack).drop("_part")
    d = packs.join(shuffled(paths.where(F.size("path") >= 2).select(*keys, "path", "length")), keys)
    of_path = ("speed_prior", "lane_idx", "is_intersection")
    sample = d.schema["path"].dataType.elementType
    double = lambda *names: [T.StructField(a, T.DoubleType()) for a in names]
    schema = T.StructType([*[d.schema[k] for k in keys], points.schema["point_id"], *double("s", "d", "ds", "dd", "path_length"), *[sample[a] for a in of_path]])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, counts = (np.asarray(b.column(a).value_lengths()).astype(np.int64) for a in ("path", "_points"))
            q, p = b.column("path").flatten(), b.column("_points").flatten()
            qx, qy, qh = (q.field(a).to_numpy(zero_copy_only=False) for a in ("x", "y", "heading"))
            x, y, heading, v = (p.field(a).to_numpy(zero_copy_only=False) for a in ("x", "y", "heading", "v"))
            row, begin, end = np.repeat(np.arange(b.num_rows), counts), sizes.cumsum() - sizes, counts.cumsum()
            first, n = begin[row], sizes[row]
            with np.errstate(all="ignore"):
                near = [nearest_samples(x[e - m : e], y[e - m : e], qx[f : f + k], qy[f : f + k]) for e, m, f, k in zip(end, counts, begin, sizes, strict=True)]
                i = np.concatenate(near) if near else np.empty(0, np.int64)
                before, after = (along_path(x, y, k, (qx, qy), first, n, step) for k in (i - 1, i))
                away, s, side = (np.where(before[0] <= after[0], one, other) for one, other in zip(before, after, strict=True))
                lacks = ~np.isfinite(away)
                at = np.where(lacks, 0, np.minimum(np.floor(np.clip(s, 0.0, (n - 1) * step) / step), n - 1)).astype(np.int64)
                a, t = qh[first + at], np.clip((s - at * step) / step, 0.0, 1.0)
                turn = wrapped(heading - wrapped(a + t * wrapped(qh[first + np.minimum(at + 1, n - 1)] - a)))
                found = (s, side, v * np.cos(turn), v * np.sin(turn))
            of = q.take(pa.array(first + at, mask=lacks))
            numbers = [pa.array(np.where(lacks, np.nan, u), from_pandas=True) for u in found]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(row)) for k in keys], p.field("point_id"), *numbers, b.column("length").take(pa.array(row)), *[pc.struct_field(of, a) for a in of_path]], names=schema.names)

    return d.mapInArrow(located, schema)


def route_features(routes: DataFrame, paths: DataFrame, graph: DataFrame) -> DataFrame:
    """The input of lanes.path_features, of routes that have a path: scenario_id, request_id, s, curvature, route array<struct<lane_idx, is_intersection, lane_change>>."""
    key = ["scenario_id", "request_id"]
    hop = routes.where("status = 'ok'").select(*key, F.posexplode("route").alias("k", "h")).select(*key, "k", F.col("h.lane_idx").alias("lane_idx"), F.col("h.lane_change").alias("lane_change"))
    hop = hop.join(graph.select("scenario_id", "lane_idx", "is_intersection"), ["scenario_id", "lane_idx"])
    route = hop.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lane_idx", "is_intersection", "lane_change"))), lambda h: F.struct(h["lane_idx"].alias("lane_idx"), h["is_intersection"].alias("is_intersection"), h["lane_change"].alias("lane_change"))).alias("route"))
    of = lambda a: F.transform("path", lambda p: p[a]).alias(a)
    return shuffled(paths.select(*key, of("s"), of("curvature"))).join(route, key)
