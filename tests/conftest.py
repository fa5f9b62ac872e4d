"""Fixtures: a local Spark session, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def sorted_rows(rows, names, order):
    at = [names.index(x) for x in order]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="session")
def matches(spark, duck, sf_dir):
    """Compares a query's rows with those of its SQL, columns by name."""

    def compare(query, sql: str) -> None:
        got = query(spark, sf_dir)
        want = duck.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(got.columns)
        order = sorted(names)
        expected = sorted_rows(want.fetchall(), names, order)
        actual = sorted_rows([tuple(r) for r in got.collect()], got.columns, order)
        assert actual == expected

    return compare
