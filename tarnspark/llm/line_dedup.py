"""Line dedup by levelled sorted runs of line hashes.

A store keeps runs of (key, n_docs), each bucketed and sorted by key, in levels. A batch is counted, merge-anti-joined
with the keys that the runs already hold as saturated (they need no further counting), and what is left becomes a new
run of level 0. When a level is full its runs are merged into one run of the next level.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, row_key, saved, skew_join, work_path


#: Rows for which a batch is added, and different dropped keys from which on a document is cut by a join.
BATCH_ROWS, MANY_KEYS = 100_000_000, 256


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


class LineRuns:
    """Levelled runs of line hashes with document counts. Runs are bucketed tables in the shared folder, so the merge
    with a batch shuffles the batch only."""

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = work_path(self.spark, "line-run")
        run.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Sorted runs merged by key, two at a time: two runs have the same buckets, so their merge has no shuffle.
        (A union of bucketed tables is no way to do it: Spark 4.1 takes it for partitioned by key and loses sums.)"""
        count = lambda c: F.coalesce(c, F.lit(0).cast("long"))

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n_docs", "n_more"), "key", "full_outer")
            return both.select("key", (count(F.col("n_docs")) + count(F.col("n_more"))).alias("n_docs"))

        return reduce(merge, (self.spark.table(n) for n in names))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> None:
        """keys: a row (key) for each document and distinct key of the batch."""
        run = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
        for name in self.names():
            run = run.join(self.spark.table(name).where(F.col("n_docs") >= self.min_docs), "key", "left_anti")
        self.levels[0].append(self._write(run))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            merged = self._write(self._merged(self.levels[at]))
            self._drop(self.levels[at])
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            at += 1
            self.levels[at].append(merged)

    def frequent(self) -> DataFrame:
        """Keys found in at least min_docs documents over all batches."""
        return self._merged(self.names()).where(F.col("n_docs") >= self.min_docs).select("key")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Forgets the tables; their files stay in the shared folder for readers of lazy results."""
        self._drop(self.names())


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops every line whose key (stripped, A-Z lower-cased) is in at least min_docs documents.

    Returns (original struct<all input columns>, n_lines, n_dropped, kept_text). Null or empty text is one empty line,
    kept. Every row is a document of its own, repeated rows too. A null id is allowed. Extra columns, whatever their names,
    stay inside `original`. An empty table gives an empty result. batches: runs that are added one after another, by default four
    and one more for each BATCH_ROWS rows.

    A document that loses more than MANY_KEYS different keys is cut line by line in an anti-join, not by looking each line up in a
    list of them, so that very long texts cost no more a line than short ones.
    """
    spark = docs.sparkSession
    batches = batches or 4 + docs.count() // BATCH_ROWS
    d = docs.select(F.struct("*").alias("original"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_key(F.col("id"), F.col("text")))
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    pairs = d.select("row", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("line"))
    pairs = saved(pairs.where(F.length("line") >= min_chars).select("row", key_hash(F.col("line")).alias("key"), "batch"), "line-pairs", ["batch"])
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(pairs.where(F.col("batch") == batch).select("key"))
    frequent = saved(runs.frequent(), "line-frequent")
    runs.close()
    hits = skew_join(pairs.select("row", "key"), frequent, ["key"], "left_semi", "line")
    drops = saved(hits.groupBy("row").agg(F.collect_set("key").alias("drops")), "line-drops")
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("drops"), key_hash(line_key(x))))
    joined = d.join(drops, "row", "left")
    long_ones = drops.where(F.size("drops") > MANY_KEYS)
    if long_ones.isEmpty():
        joined = joined.withColumn("kept", F.when(F.col("drops").isNull(), lines).otherwise(kept))
    else:
        joined = joined.join(_cut_long(d, long_ones), "row", "left").withColumn("kept", F.when(F.col("drops").isNull(), lines).when(F.size("drops") > MANY_KEYS, F.coalesce("left", F.array().cast("array<string>"))).otherwise(kept))
    return joined.select("original", F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def _cut_long(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """(row, left): the lines that stay of documents whose dropped keys are many."""
    own = docs.select("row", "text").join(drops.select("row"), "row").dropDuplicates(["row"]).select("row", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    gone = drops.select("row", F.explode("drops").alias("key"))
    stays = own.withColumn("key", key_hash(line_key(F.col("line")))).join(gone, ["row", "key"], "left_anti")
    return stays.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("left")).select("row", F.transform("left", lambda x: x["line"]).alias("left"))
