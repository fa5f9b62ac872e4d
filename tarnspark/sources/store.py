"""The results store: typed CSV loading, key checks, the frozen split, replacement of runs."""

from __future__ import annotations

import hashlib
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the store's tables, in order.
RUNS = "run_id string, created_at timestamp_ntz, config_name string, config_json string, agent_mode string, planner string, dataset string, git_sha string, hardware string, capabilities int, n_scenarios int"
METRICS = (
    "run_id string, scenario_id string, status string, collision int, at_fault_collision int, collision_time double, collision_agent_type int, drivable_area_violation int, max_offroad_dist double, "
    "wrong_direction int, min_ttc double, ttc_below_thresh_frac double, progress_ratio double, route_completion double, speeding_frac double, max_abs_a_lon double, max_abs_a_lat double, "
    "max_abs_jerk double, max_abs_yaw_rate double, comfort_violation int, ade double, fde double, n_cycles int, plan_us_p50 double, plan_us_p99 double, plan_us_mean double, plan_us_max double, "
    "refine_us_p50 double, refine_iters_mean double, refine_converged_frac double, hot_path_allocs long"
)
FEATURES = (
    "scenario_id string, dataset string, city string, ego_maneuver string, route_len_m double, max_abs_curvature double, crosses_intersection int, n_intersection_lanes_on_route int, route_lane_changes int, "
    "n_agents int, n_vehicles int, n_peds int, n_cyclists int, n_agents_within_30m int, min_agent_dist_t0 double, n_oncoming_within_40m int, n_crossing_within_40m int, lead_agent_gap double, "
    "agent_density double, ego_speed_t0 double, ego_mean_speed double, ego_max_speed double, speed_regime string, ego_stops int, has_traffic_light int, light_state_t0 string, has_stop_sign int, "
    "has_crosswalk_on_route int, occluded_agent_frac double, split string"
)
FAILURE_CLASSES = (
    "job_id string, class_rank int, target string, rule string, rule_json string, depth int, disc_n int, disc_failures int, disc_rate double, disc_lift double, conf_n int, conf_failures int, "
    "conf_rate double, conf_rate_lo double, conf_rate_hi double, conf_lift double, conf_lift_lo double, conf_lift_hi double, base_rate double, failure_mass_share double, p_value double, q_value double, significant int"
)
MINING_JOBS = "job_id string, created_at timestamp_ntz, run_id string, target string, n_candidates_tested int, alpha double, n_bootstrap int, beam_width int, max_depth int, notes string"
GATE_RESULTS = "gate_id string, baseline_run string, candidate_run string, scope string, metric string, baseline_val double, candidate_val double, delta double, delta_lo double, delta_hi double, n_paired int, verdict string"
TABLES = {"runs": RUNS, "metrics": METRICS, "features": FEATURES, "failure_classes": FAILURE_CLASSES, "mining_jobs": MINING_JOBS, "gate_results": GATE_RESULTS}
# Columns that a file must have.
REQUIRED = {"runs": ("run_id", "created_at", "config_name", "agent_mode", "planner", "dataset"), "metrics": ("run_id", "scenario_id", "status"), "features": ("scenario_id", "dataset")}
# The strings that stand for NULL in CSV files.
NULLS = ("", "NA", "N/A", "NULL", "null", "nan", "NaN", "None")
#: CSV files have a header, and quotes in quoted fields are doubled; readers and writers share this.
DIALECT = {"header": True, "quote": '"', "escape": '"'}
#: Buckets of features by a hash of the scenario's id: a load writes those anew that it touches.
FEATURE_BUCKETS = 64


def split_name(scenario_id: str) -> str:
    digest = hashlib.blake2b(scenario_id.encode(), digest_size=8).digest()
    return "confirmation" if int.from_bytes(digest, "big") % 2 else "discovery"


@F.pandas_udf(T.StringType())
def split_of(ids: pd.Series) -> pd.Series:
    """The frozen split of scenario ids, a function of the id alone; NULL for NULL."""
    return ids.map(split_name, na_action="ignore")


def typed(raw: Column, kind: T.DataType) -> Column:
    """A CSV field as kind: trimmed, NULL strings as NULL; integers may be written as decimals and are rounded. What is neither NULL nor readable,
    or out of range, raises."""
    text = F.trim(raw)
    text = F.when(~text.isin(*NULLS), text)
    if isinstance(kind, T.StringType):
        return text
    value = text.try_cast(kind)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        number = text.try_cast("double")
        value = F.coalesce(value, F.round(F.when(F.abs(number) < 2.0**62, number)).cast("long").try_cast(kind))
    return F.when(text.isNull(), F.lit(None)).when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"no {kind.simpleString()}: "), text)))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = (), line_ends: bool = False) -> DataFrame:
    """A CSV file in DIALECT in the columns of schema. All fields are read as strings; columns that the file lacks are NULL,
    or raise if required; unknown columns are left out with a warning. line_ends: quoted fields may hold line ends, and a file is then
    read by one task."""
    raw = spark.read.options(**DIALECT, inferSchema=False, multiLine=line_ends).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    unknown = [c for c in raw.columns if c not in schema.names]
    if unknown:
        warnings.warn(f"{path}: columns {', '.join(unknown)} are unknown and left out", stacklevel=2)
    return raw.select(*[(typed(F.col(f"`{f.name}`"), f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def duplicate_keys(df: DataFrame, keys: list[str], limit: int | None = 3) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return found.limit(limit) if limit else found


def orphans(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Run ids that metrics have and runs lack."""
    return metrics.join(runs, "run_id", "left_anti").select("run_id").distinct()


def replaced(existing: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """existing with all rows of the staged keys replaced by staged."""
    bad = duplicate_keys(staged, [c for c in ("run_id", "scenario_id") if c in staged.columns]).collect()
    if bad:
        raise ValueError(f"duplicate keys: {bad}")
    return existing.join(staged.select(*keys).distinct(), keys, "left_anti").unionByName(staged)


def verify_splits(features: DataFrame) -> int:
    """The number of rows, if every stored split is the one of its id."""
    wrong = features.where(~F.col("split").eqNullSafe(split_of(F.col("scenario_id").cast("string")))).select("scenario_id").limit(3).collect()
    if wrong:
        raise ValueError(f"split differs from the rule: {[r[0] for r in wrong]}")
    return features.count()


def split_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


class Store:
    """The results store: six tables of fixed columns as Parquet below a folder. Tables are replaced by their first key (a run, a job with its target, a
    gate) through dynamic partition overwrite, so a load that is run again replaces what it wrote; features are replaced by
    scenario, in the buckets of their ids that a load touches."""

    #: What a load replaces as a whole; these columns are the folders of a table.
    PARTITIONS = {"runs": ["run_id"], "metrics": ["run_id"], "features": ["bucket"], "failure_classes": ["job_id", "target"], "mining_jobs": ["job_id"], "gate_results": ["gate_id"]}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[name])

    def _list(self, path: str) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return any("=" in x for x in self._list(f"{self.root}/{name}"))

    def table(self, name: str) -> DataFrame:
        """The table's rows; none where nothing has been written yet."""
        return self._stored(name).select(*self.schema(name).names)

    def _stored(self, name: str) -> DataFrame:
        """table() with bucket, where the table has it."""
        schema = self.schema(name)
        stored = T.StructType([*schema, *[T.StructField(c, T.IntegerType()) for c in self.PARTITIONS[name] if c not in schema.names]])
        return self.spark.read.schema(stored).parquet(f"{self.root}/{name}") if self.exists(name) else self.spark.createDataFrame([], stored)

    def replace(self, name: str, rows: DataFrame) -> int:
        """Writes rows in the place of all that share their partition; returns their number."""
        schema, seen = self.schema(name), Observation()
        own = [F.col(c) for c in self.PARTITIONS[name] if c not in schema.names]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *own).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.PARTITIONS[name]).parquet(f"{self.root}/{name}")
        return seen.get["n"]

    def _staged(self, name: str, path: str, keys: list[str]) -> DataFrame:
        staged = read_csv(self.spark, path, self.schema(name), REQUIRED[name], line_ends=name == "runs")
        bad = duplicate_keys(staged, keys).collect()
        if bad:
            raise ValueError(f"{path}: duplicate keys {[tuple(r)[:-1] for r in bad]}")
        return staged

    def load_runs(self, path: str) -> int:
        return self.replace("runs", self._staged("runs", path, ["run_id"]))

    def load_metrics(self, path: str) -> int:
        """Warns of runs that the store lacks, as their configuration and hardware are not known."""
        staged = self._staged("metrics", path, ["run_id", "scenario_id"])
        lost = [r[0] for r in orphans(staged, self.table("runs")).limit(3).collect()]
        if lost:
            warnings.warn(f"{path}: the store has no run {', '.join(lost)}", stacklevel=2)
        return self.replace("metrics", staged)

    def load_features(self, path: str) -> int:
        """The split is a function of the scenario's id: one that the file gives is ignored with a warning, and a stored one that differs from
        the rule stops the load."""
        if "split" in self.spark.read.options(**DIALECT).csv(path).columns:
            warnings.warn(f"{path}: its column split is ignored", stacklevel=2)
        bucket = F.pmod(F.xxhash64("scenario_id"), F.lit(FEATURE_BUCKETS)).cast("int")
        staged = self._staged("features", path, ["scenario_id"]).withColumns({"split": split_of("scenario_id"), "bucket": bucket})
        touched = [r[0] for r in staged.select("bucket").distinct().collect()]
        held = self._stored("features").where(F.col("bucket").isin(touched))
        verify_splits(held.join(staged.select("scenario_id"), "scenario_id", "left_semi"))
        n_held = held.join(staged.select("scenario_id"), "scenario_id", "left_anti").count()
        return self.replace("features", replaced(held, staged, ["scenario_id"])) - n_held

    def load_folder(self, folder: str) -> dict[str, int]:
        """runs.csv, features.csv and metrics.csv of a folder, in this order; raises if it has none of them."""
        there = set(self._list(folder))
        out = {name: getattr(self, f"load_{name}")(f"{folder}/{name}.csv") for name in ("runs", "features", "metrics") if f"{name}.csv" in there}
        if not out:
            raise FileNotFoundError(f"{folder} has none of runs.csv, features.csv and metrics.csv")
        return out

    def load_files(self, folder: str) -> tuple[dict[str, int], dict[str, str]]:
        """runs*.csv, then features*.csv, then metrics*.csv of a folder: rows of each file, and the error of each file that could not be loaded; the others are."""
        rows, errors = {}, {}
        for name in ("runs", "features", "metrics"):
            for file in sorted(x for x in self._list(folder) if x.startswith(name) and x.endswith(".csv")):
                try:
                    rows[file] = getattr(self, f"load_{name}")(f"{folder}/{file}")
                except Exception as e:  # one bad file does not keep the others out
                    errors[file] = str(e).splitlines()[0]
        return rows, errors

    def save_mining(self, job_id: str, run_id: str, classes: DataFrame, job: dict, created_at: str) -> int:
        """A mining job and its classes (miner.search), ranked by mass; a number that is not finite becomes NULL."""
        when = F.lit(created_at).cast("timestamp_ntz")
        notes = ", ".join(f"{k}={v}" for k, v in job.items())
        self.replace("mining_jobs", self.spark.createDataFrame([(job_id, run_id, notes, *(job[k] for k in ("target", "n_candidates_tested", "alpha", "n_bootstrap", "beam_width", "max_depth")))], "job_id string, run_id string, notes string, target string, n_candidates_tested int, alpha double, n_bootstrap int, beam_width int, max_depth int").withColumn("created_at", when))
        named = classes.withColumns({"job_id": F.lit(job_id), "target": F.lit(job["target"]), "class_rank": F.col("rank_mass")})
        return self.replace("failure_classes", finite(named))

    def save_gate(self, gate_id: str, baseline_run: str, candidate_run: str, cells: DataFrame) -> int:
        return self.replace("gate_results", finite(cells.withColumns({"gate_id": F.lit(gate_id), "baseline_run": F.lit(baseline_run), "candidate_run": F.lit(candidate_run)})))

    def export_csv(self, name: str, path: str) -> None:
        """A table as CSV in DIALECT, floats with six significant digits and NULL as nothing."""
        d = self.table(name)
        d.select(*[F.format_string("%.6g", c).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes]).withColumns({c: F.when(self._present(d, c), F.col(c)) for c, t in d.dtypes if t == "double"}).write.mode("overwrite").options(**DIALECT).csv(path)

    @staticmethod
    def _present(d: DataFrame, c: str) -> Column:
        return ~F.col(c).isin("null", "NaN")


def finite(d: DataFrame) -> DataFrame:
    """d with NULL for every double that is NaN or infinite."""
    return d.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
