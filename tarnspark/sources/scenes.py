"""Scenes as nested rows: the view of a stored scene that drawing and inspection read, and dumps of it as JSON with a checked contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Version of the dumps, and what a dump must have.
VERSION, REQUIRED = 1, ("scenario_id", "dt", "ego", "ego_logged")
_TEXT, _INT, _LONG, _REAL, _FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_PLACES = T.ArrayType(T.ArrayType(_REAL))
_STATES = T.ArrayType(_struct(t=_REAL, x=_REAL, y=_REAL, heading=_REAL, v=_REAL, valid=_FLAG))
# The fields of a dump, in order.
SCENE = _struct(
    schema=_INT, scenario_id=_TEXT, dataset=_TEXT, agent_mode=_TEXT, planner=_TEXT, dt=_REAL, origin=T.ArrayType(_REAL), capabilities=_INT, lanes=T.ArrayType(_struct(id=_LONG, is_intersection=_FLAG, centerline=_PLACES)),
    polygons=T.ArrayType(_struct(kind=_TEXT, points=_PLACES)), route=T.ArrayType(_LONG), reference_path=_PLACES, ego=_STATES, ego_logged=_STATES, agents=T.ArrayType(_struct(id=_TEXT, type=_TEXT, length=_REAL, width=_REAL, states=_STATES)),
    plans=T.ArrayType(_struct(step=_INT, chosen=_INT)), events=T.ArrayType(_struct(t=_REAL, kind=_TEXT)), metrics=T.MapType(_TEXT, _REAL),
)


def _ordered(order: str, value: Column) -> Column:
    """An aggregate's array of values in order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def _places(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def scene_view(tracks: DataFrame, lanes: DataFrame, polygons: DataFrame, scenes: DataFrame) -> DataFrame:
    """A row a scene in SCENE's columns, from the log alone: no plan, route or event is in it, and `planner` says so.

    tracks: scenario_id, agent_idx (0 the ego), step, valid, kind, x, y, heading, vx, vy, length, width; lanes: scenario_id, lane_idx, points, is_intersection; polygons: scenario_id,
    kind, ring; scenes: scenario_id, dt and, where known, dataset, origin, capabilities. A scene without an ego is left out.
    """
    c, key = F.col, "scenario_id"
    state = F.struct(F.round(c("step") * c("dt"), 4).alias("t"), "x", "y", "heading", F.hypot("vx", "vy").alias("v"), "valid")
    own = tracks.join(scenes.select(key, "dt"), key)
    t = own.groupBy(key, "agent_idx").agg(_ordered("step", state).alias("states"), *[F.first(x).alias(x) for x in ("kind", "length", "width")])
    agent = F.struct(F.concat(F.lit("agent:"), c("agent_idx").cast("string")).alias("id"), c("kind").alias("type"), "length", "width", "states")
    a = t.groupBy(key).agg(F.first(F.when(c("agent_idx") == 0, c("states")), ignorenulls=True).alias("ego"), F.filter(_ordered("agent_idx", F.when(c("agent_idx") > 0, agent)), lambda x: x.isNotNull()).alias("agents"))
    ways = lanes.groupBy(key).agg(_ordered("lane_idx", F.struct(c("lane_idx").cast("long").alias("id"), "is_intersection", _places(c("points")).alias("centerline"))).alias("lanes"))
    areas = polygons.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", _places(c("ring")).alias("points")))).alias("polygons"))
    d = scenes.join(a.where("ego IS NOT NULL"), key).join(ways, key, "left").join(areas, key, "left")
    given = {"schema": F.lit(VERSION), "agent_mode": F.lit("log"), "planner": F.lit("none: from the stored log"), "ego_logged": c("ego"), "scenario_id": c(key).cast("string")}
    empty = {f.name: F.array() for f in SCENE if isinstance(f.dataType, T.ArrayType)} | {"metrics": F.create_map()}

    def field(f: T.StructField) -> Column:
        value = given.get(f.name, c(f.name) if f.name in d.columns else F.lit(None))
        value = value.cast(f.dataType)
        return (F.coalesce(value, empty[f.name].cast(f.dataType)) if f.name in empty else value).alias(f.name)

    return d.select(*[field(f) for f in SCENE])


def write_scenes(scenes: DataFrame, path: str) -> None:
    """One JSON object a line and scene."""
    scenes.write.json(path)


def read_scenes(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scenes in SCENE's columns, quarantined rows: path, reason, raw) of dumps below path, an object a line, or a file with whole_files.

    A dump that is no JSON, is of another version or lacks a required field does not stop the others; each is reported once, with its first fault.
    """
    raw = "_raw"
    read = spark.read.schema(T.StructType([*SCENE, T.StructField(raw, T.StringType())])).option("columnNameOfCorruptRecord", raw).option("mode", "PERMISSIVE").option("multiLine", whole_files)
    d = read.json(path).withColumn("path", F.input_file_name())
    fault = F.when(F.col(raw).isNotNull(), "not readable as JSON of the dump's fields")
    fault = fault.when(~F.col("schema").eqNullSafe(F.lit(VERSION)), F.concat(F.lit("version "), F.coalesce(F.col("schema").cast("string"), F.lit("none")), F.lit(f", not {VERSION}")))
    for name in REQUIRED:
        fault = fault.when(F.col(name).isNull(), f"no {name}")
    # All columns are kept until here, as Spark reads a corrupt record's text only next to others.
    d = d.withColumn("reason", fault)
    return d.where("reason IS NULL").select(*SCENE.names), d.where("reason IS NOT NULL").select("path", "reason", F.coalesce(F.col(raw), F.to_json(F.struct(*SCENE.names))).alias("raw"))
