"""Ingest of recorded scenes: track filtering with reasons, dense tracks, recentring, and lanes from map JSON."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Steps of a scenario, least travel (m) and vehicle lanes; limits of stored scenes; reasons in the order they are looked for.
N_STEPS, MIN_TRAVEL, MIN_LANES = 110, 5.0, 2
MAX_AGENTS, MAX_LANES, MAX_POINTS = 4096, 65_536, 4 << 20
REASONS = ("missing_input_files", "parse_error", "empty_parquet", "unexpected_num_timestamps", "no_av_track", "av_not_valid_at_t0", "ego_travel_below_5m", "fewer_than_2_vehicle_lanes")
# Lane types; cities in the order of their codes; classes of raw object types; footprints (length, width in m) by class.
LANE_TYPES = ("VEHICLE", "BIKE", "BUS")
CITIES = ("austin", "miami", "pittsburgh", "dearborn", "washington-dc", "palo-alto")
KIND_OF = {
    "vehicle": "vehicle", "pedestrian": "pedestrian", "cyclist": "cyclist", "riderless_bicycle": "cyclist", "motorcyclist": "motorcyclist", "bus": "bus",
    "static": "static", "background": "background", "construction": "construction",
}
FOOTPRINTS = {
    "vehicle": (4.5, 2.0), "bus": (12.0, 2.55), "motorcyclist": (2.2, 0.8), "cyclist": (1.8, 0.7), "pedestrian": (0.7, 0.7),
    "construction": (0.6, 0.6), "static": (1.0, 1.0), "background": (1.0, 1.0), "unknown": (1.0, 1.0),
}
# The columns of track files, in order.
TRACK_COLUMNS = ("track_id", "object_type", "object_category", "timestep", "position_x", "position_y", "heading", "velocity_x", "velocity_y", "num_timestamps", "city")
_POINT = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_LANE = T.StructType([T.StructField("id", T.LongType()), T.StructField("lane_type", T.StringType()), T.StructField("is_intersection", T.BooleanType()), T.StructField("centerline", _POINT), T.StructField("successors", T.ArrayType(T.LongType())), T.StructField("predecessors", T.ArrayType(T.LongType())), T.StructField("left_neighbor_id", T.LongType()), T.StructField("right_neighbor_id", T.LongType())])
MAP = T.StructType([T.StructField("lane_segments", T.MapType(T.StringType(), _LANE)), T.StructField("drivable_areas", T.MapType(T.StringType(), T.StructType([T.StructField("area_boundary", _POINT)]))), T.StructField("pedestrian_crossings", T.MapType(T.StringType(), T.StructType([T.StructField("edge1", _POINT), T.StructField("edge2", _POINT)])))])


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """The columns that the engine uses, and scenario_id where the files have it; the scan reads no others."""
    d = spark.read.parquet(path)
    return d.select(*[c for c in ("scenario_id", *TRACK_COLUMNS) if c in d.columns])


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """(path, map) of JSON files, one a scenario."""
    return spark.read.schema(MAP).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), F.struct("*").alias("map"))


def scenario_files(listing: DataFrame) -> DataFrame:
    """(scenario_id, tracks, map, reason) of a listing (scenario_id: the folder's name, path): the files named after the scenario, else the first of
    each kind; reason is missing_input_files where there is no pair."""
    name = F.element_at(F.split("path", "/"), -1)
    exact = {"tracks": F.concat(F.lit("scenario_"), F.col("scenario_id"), F.lit(".parquet")), "map": F.concat(F.lit("log_map_archive_"), F.col("scenario_id"), F.lit(".json"))}
    like = {"tracks": r"^scenario_.*\.parquet$", "map": r"^log_map_archive_.*\.json$"}
    d = listing.groupBy("scenario_id").agg(*[x for k in like for x in (F.min(F.when(name == exact[k], F.col("path"))).alias(f"{k}_exact"), F.min(F.when(name.rlike(like[k]), F.col("path"))).alias(f"{k}_any"))])
    named = F.col("tracks_exact").isNotNull() & F.col("map_exact").isNotNull()
    d = d.select("scenario_id", *[F.when(named, F.col(f"{k}_exact")).otherwise(F.col(f"{k}_any")).alias(k) for k in like])
    whole = F.col("tracks").isNotNull() & F.col("map").isNotNull()
    return d.select("scenario_id", *[F.when(whole, F.col(k)).alias(k) for k in like], F.when(~whole, REASONS[0]).alias("reason"))


def lane_rows(maps: DataFrame) -> DataFrame:
    """(path, src, lane_idx, lane_type, is_intersection, points, refs) of the lanes of known types, numbered in the order of their ids; a lane's id is its
    own field, else its key."""
    lanes = maps.select("path", F.explode("map.lane_segments").alias("key", "v"))
    kind = F.upper("v.lane_type")
    lanes = lanes.where(kind.isin(*LANE_TYPES)).select("path", F.coalesce("v.id", F.col("key").cast("long")).alias("src"), kind.alias("lane_type"), F.coalesce("v.is_intersection", F.lit(False)).alias("is_intersection"), F.col("v.centerline").alias("points"), "v")
    none = F.array().cast("array<bigint>")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), to.alias("to")) for k, to in (("succ", F.coalesce("v.successors", none)), ("pred", F.coalesce("v.predecessors", none)), ("left", F.array_compact(F.array("v.left_neighbor_id"))), ("right", F.array_compact(F.array("v.right_neighbor_id"))))])
    return lanes.select("path", "src", (F.row_number().over(Window.partitionBy("path").orderBy("src")) - 1).alias("lane_idx"), "lane_type", "is_intersection", "points", kinds.alias("refs"))


def unknown_lanes(maps: DataFrame) -> DataFrame:
    """(path, n_unknown): lanes of each map that lane_rows() leaves out, as their type is unknown; maps without any are left out."""
    kind = F.upper(F.coalesce("v.lane_type", F.lit("")))
    lanes = maps.select("path", F.explode("map.lane_segments").alias("key", "v")).where(~kind.isin(*LANE_TYPES))
    return lanes.groupBy("path").agg(F.count(F.lit(1)).alias("n_unknown"))


def lane_edges(maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (path, src, dst, kind) between lanes of a map, kind one of succ, pred, left and right, and the number of dropped references to lanes it
    lacks, by kind. Maps are cut out around a log, so lanes at the border refer to some that are not there."""
    lanes = lane_rows(maps)
    edges = lanes.select("path", "src", F.explode("refs").alias("e")).select("path", "src", "e.kind", F.explode("e.to").alias("dst"))
    known = lanes.select("path", F.col("src").alias("dst"), F.lit(True).alias("known"))
    edges = edges.join(known, ["path", "dst"], "left")
    return edges.where("known").select("path", "src", "dst", "kind"), edges.where("known IS NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n_dropped"))


def polygons(maps: DataFrame) -> DataFrame:
    """(path, kind, ring): drivable areas of three points or more, and crosswalks, whose second edge is turned round so that the ring doesn't cross itself."""
    area = maps.select("path", F.explode("map.drivable_areas").alias("k", "v")).select("path", F.lit("drivable").alias("kind"), F.col("v.area_boundary").alias("ring")).where(F.size("ring") >= 3)
    cross = maps.select("path", F.explode("map.pedestrian_crossings").alias("k", "v")).where((F.size("v.edge1") > 0) & (F.size("v.edge2") > 0))
    return area.unionByName(cross.select("path", F.lit("crosswalk").alias("kind"), F.concat("v.edge1", F.reverse("v.edge2")).alias("ring")))


def city_code(name: Column) -> Column:
    """The number of a city's name, however it is written; 6 for others."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "_", "-")
    found = F.array_position(F.array(*map(F.lit, CITIES)), plain)
    return F.when(found > 0, found - 1).otherwise(len(CITIES)).cast("int")


def agent_kind(object_type: Column) -> Column:
    """The class that an agent of a raw type counts as."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in KIND_OF.items() for x in (k, v)])[object_type], F.lit("unknown"))


def with_footprints(agents: DataFrame, footprints: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """agents (kind) with length and width, constants of their class; classes without one take unknown's."""
    sizes = FOOTPRINTS | (footprints or {})
    size = F.create_map(*[x for k, (a, b) in sizes.items() for x in (F.lit(k), F.struct(F.lit(a).alias("length"), F.lit(b).alias("width")))])
    own = F.coalesce(size[F.col("kind")], size[F.lit("unknown")])
    return agents.withColumns({"length": own["length"], "width": own["width"]})


@F.pandas_udf(T.LongType())
def id_hash(ids: pd.Series) -> pd.Series:
    """64 bits of a track's id, as a signed number."""
    return ids.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True), na_action="ignore").astype("Int64")


def reject_reasons(tracks: DataFrame, lanes: DataFrame | None = None, files: DataFrame | None = None, ego: str = "AV", n_steps: int = N_STEPS, min_travel: float = MIN_TRAVEL, min_lanes: int = MIN_LANES) -> DataFrame:
    """(scenario_id, reason): the first rule that a scenario breaks, or NULL. tracks: scenario_id, track_id, timestep, position_x, position_y, and
    num_timestamps, as the file states it, where it has it (else the different timesteps are counted); lanes: scenario_id, lane_type; files: scenario_id, reason (a file that is
    missing or can't be read). A file without rows is one that files has and tracks does not. Travel is the ego's arc length over its valid steps."""
    mine = F.col("track_id") == ego
    w = Window.partitionBy("scenario_id", "track_id").orderBy("timestep")
    step = F.hypot(F.col("position_x") - F.lag("position_x").over(w), F.col("position_y") - F.lag("position_y").over(w))
    stated = F.first("num_timestamps") if "num_timestamps" in tracks.columns else F.count_distinct("timestep")
    d = tracks.withColumn("__step", step).groupBy("scenario_id").agg(
        stated.alias("steps"), F.count(F.when(mine, 1)).alias("rows"), F.count(F.when(mine & (F.col("timestep") == 0), 1)).alias("at_start"), F.coalesce(F.sum(F.when(mine, F.col("__step"))), F.lit(0.0)).alias("travel"),
    )
    if files is not None:
        d = files.select("scenario_id", F.col("reason").alias("file_reason")).join(d, "scenario_id", "left")
    else:
        d = d.withColumn("file_reason", F.lit(None).cast("string"))
    if lanes is not None:
        own = lanes.groupBy("scenario_id").agg(F.count_if(F.col("lane_type") == LANE_TYPES[0]).alias("lanes"))
        d = d.join(own, "scenario_id", "left").withColumn("lanes", F.coalesce("lanes", F.lit(0)))
    else:
        d = d.withColumn("lanes", F.lit(min_lanes))
    _, _, empty, steps, no_ego, late, still, few = REASONS
    reason = F.when(F.col("file_reason").isNotNull(), F.col("file_reason")).when(F.col("steps").isNull(), empty).when(F.col("steps") != n_steps, F.concat(F.lit(f"{steps}:"), F.col("steps").cast("string")))
    reason = reason.when(F.col("rows") == 0, no_ego).when(F.col("at_start") == 0, late).when(F.col("travel") < min_travel, still).when(F.col("lanes") < min_lanes, few)
    return d.select("scenario_id", reason.alias("reason"))


def reason_counts(rejected: DataFrame) -> DataFrame:
    """(reason, n): scenarios by reason, without what follows its colon; NULL are those that stay."""
    return rejected.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def manifest(rejected: DataFrame) -> dict:
    """Totals, counts by reason, and the constants in force."""
    counts = {r["reason"]: r["n"] for r in reason_counts(rejected).collect()}
    kept = counts.pop(None, 0)
    return {"n_scenarios": kept + sum(counts.values()), "n_converted": kept, "n_rejected": sum(counts.values()), "reasons": counts, "n_steps": N_STEPS, "min_travel_m": MIN_TRAVEL, "min_vehicle_lanes": MIN_LANES, "footprints": FOOTPRINTS}


def structural_faults(scenarios: DataFrame, edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """(scenario_id, fault): scenarios (scenario_id, n_agents, n_steps, n_lanes, n_points, dt, ego_index) whose counts are over the limits or whose step or ego is out
    of range, and those with edges (scenario_id, src, dst) to lanes (scenario_id, lane_idx) that they lack."""
    c = F.col
    fault = F.when((c("n_agents") > MAX_AGENTS) | (c("n_steps") > MAX_AGENTS) | (c("n_lanes") > MAX_LANES) | (c("n_points") > MAX_POINTS), "count_over_limit")
    fault = fault.when(~((c("dt") > 0) & (c("dt") <= 1)), "dt_out_of_range").when(~c("ego_index").between(0, c("n_agents") - 1), "ego_out_of_range")
    ends = edges.select("scenario_id", F.explode(F.array("src", "dst")).alias("lane_idx"))
    lost = ends.join(lanes, ["scenario_id", "lane_idx"], "left_anti").select("scenario_id", F.lit("edge_to_no_lane").alias("fault")).distinct()
    return scenarios.select("scenario_id", fault.alias("fault")).where("fault IS NOT NULL").unionByName(lost)


def scene_statistics(states: DataFrame, lanes: DataFrame) -> DataFrame:
    """One row: n_scenarios, means of agents, steps and lanes by scenario, shares of valid states, mean lanes of intersections."""
    s = states.groupBy("scenario_id").agg(F.count_distinct("track_id").alias("agents"), F.count_distinct("timestep").alias("steps"), F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("n"))
    ls = lanes.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("lanes"), F.count_if("is_intersection").alias("crossing"))
    d = s.join(ls, "scenario_id", "left").na.fill(0, ["lanes", "crossing"])
    return d.agg(F.count(F.lit(1)).alias("n_scenarios"), *[F.avg(x).alias(f"mean_{x}") for x in ("agents", "steps", "lanes", "crossing")], F.sum("valid").alias("n_valid"), (F.sum("n") - F.sum("valid")).alias("n_invalid"))


def last_states(tracks: DataFrame, order_by: str) -> DataFrame:
    """(scenario_id, track_id, timestep, state, n_repeats): of repeated states the last by order_by, and how many others there are."""
    key = ["scenario_id", "track_id", "timestep"]
    values = [c for c in tracks.columns if c not in (*key, order_by)]
    return tracks.groupBy(*key).agg(F.max_by(F.struct(*values), order_by).alias("state"), (F.count(F.lit(1)) - 1).alias("n_repeats"))


def densify(tracks: DataFrame, order_by: str, n_steps: int = 110) -> DataFrame:
    """Every track at every step, with valid and agent_idx (the rank of its id in the scenario). Of repeated states the last by order_by wins;
    n_repeats counts the others."""
    key = ["scenario_id", "track_id", "timestep"]
    values = [c for c in tracks.columns if c not in (*key, order_by)]
    last = last_states(tracks, order_by)
    agents = last.select("scenario_id", "track_id").distinct()
    rank = F.dense_rank().over(Window.partitionBy("scenario_id").orderBy("track_id")) - 1
    grid = agents.withColumn("agent_idx", rank).withColumn("timestep", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))
    d = grid.join(last, key, "left")
    return d.select(*key, "agent_idx", F.col("state").isNotNull().alias("valid"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"), *[F.col(f"state.{c}").alias(c) for c in values])


def recentred(states: DataFrame, ego: str = "AV") -> DataFrame:
    """position_x and position_y relative to the ego's at step 0; scenarios without it are left out."""
    origin = states.where((F.col("track_id") == ego) & (F.col("timestep") == 0)).groupBy("scenario_id").agg(F.first("position_x").alias("ox"), F.first("position_y").alias("oy"))
    return states.join(origin, "scenario_id").withColumns({"position_x": F.col("position_x") - F.col("ox"), "position_y": F.col("position_y") - F.col("oy")}).drop("ox", "oy")
