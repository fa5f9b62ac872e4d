"""Work tables: results that several later steps read, written once into the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder with a local master, else it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/tarnspark-work/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written as a work table and read again, which cuts its lineage: a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
