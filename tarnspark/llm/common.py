"""Helpers that the operators of this subpackage share: work tables, row keys, skew-safe joins, raw file output."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as white space between words and around lines: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is heavy if it holds more than 1/HEAVY of the rows, so there are fewer than HEAVY such keys.
HEAVY = 1000
#: Bytes of an Arrow batch.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered(dict):
    """make(key) of keys already asked for, in two generations that hold about `limit` bytes in all: what is not asked for while
    the younger one fills is forgotten with the elder. Keys over LONGEST are made anew each time. Values are bytes or numbers."""

    #: Bytes that an entry takes beside its key's and value's own length, and the length of keys that are not stored.
    ENTRY, LONGEST = 180, 64

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.half, self.size, self.elder = make, limit // 2, 0, {}

    def __missing__(self, key):
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            self.size += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.size > self.half:
                self.elder, self.size = dict(self), 0
                self.clear()
            self[key] = value
        return value


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if the master is
    local; on a cluster it raises, as each executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        root = "file://" + tempfile.mkdtemp(prefix="tarnspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tarnspark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cuts lineage: df written as a table in the shared folder, and read again."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Deletes the work tables of this application. Results are read from them lazily, so only after all results have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tarnspark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Rows travel to Python workers in Arrow batches of about `limit` bytes (a longer text is a batch of its own), so that a worker's
    memory is bounded whatever the texts' lengths. Spark reads this from the session when a lazy result is run, so it stays
    set there; a lower setting is kept, and results don't depend on it."""
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    size = re.fullmatch(r"(-?\d+)b?", held)
    if not size or not 0 < int(size[1]) <= limit:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def row_key(id_col: Column, text: Column) -> Column:
    """16 bytes that identify a row by id and text, null or not; rows equal in both share a key and a fate."""
    mark = F.when(id_col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), id_col.cast("string")))
    return F.unhex(F.md5(F.concat(mark, F.lit(":"), F.coalesce(F.concat(F.lit("+"), text), F.lit("-")))))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, label: str) -> DataFrame:
    """left joined to right, which has one row a key. Rows of left's heavy keys (fewer than HEAVY keys, or than there are partitions if they
    are more) meet a broadcast of as many rows of right at most; all the others are shuffled, no key of them holding over such a share of the rows."""
    keys = list(keys)
    total, share = left.count(), max(HEAVY, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = saved(left.groupBy(*keys).count().where(F.col("count") * share > total).select(*keys), f"{label}-heavy")
    hot = left.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), keys, "left_semi")), keys, how)
    rest = left.join(F.broadcast(heavy), keys, "left_anti").join(right, keys, how)
    return hot.unionByName(rest)


def numbered(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """df with `at`, each row's place from 0 in the total order, by a distributed sort: places within the partitions of a range
    partitioning plus the sizes of the partitions before. Give a last column to `order` that differs between equal rows where these may be many."""
    places = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    places = saved(places, label)
    part = F.shiftright("__place", 33)
    sizes = places.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))  # a row a partition
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    out = places.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return out.withColumn("at", F.col("__before") + F.col("__place") - F.shiftleft("__part", 33)).drop("__part", "__place", "__before")


def write_blobs(df: DataFrame, column: str, path: str, trailer: bytes, folder: str | None = None) -> None:
    """Writes each row's bytes as a file of its own, followed by trailer, through Spark's committed file output; with folder, a
    column, into folders <folder>=<value>.

    The text writer emits a string's bytes as they are, then the line separator; ISO-8859-1 makes any bytes a separator.
    """
    names = [folder] if folder else []
    (
        df.select(F.col(column).cast("string").alias("value"), *names)
        .write.partitionBy(*names)
        .option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", trailer.decode("latin-1"))
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files below path, whole: path, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
