"""The results store: typed loads, refusals and warnings, replacement, sinks."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from tarnspark.operators import gate, miner, report
from tarnspark.sources import store


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    put("runs.csv", "run_id,created_at,config_name,agent_mode,planner,dataset,capabilities\na,2024-01-01 00:00:00,base,reactive,p,d,24\nb,2024-01-02 00:00:00,base,log_replay,p,d,24\n")
    put("metrics.csv", "run_id,scenario_id,status,collision,min_ttc\na,s1,ok,1.0,0.5\na,s2,ok,NA,nan\nb,s1,ok, 0 ,\n")
    put("features.csv", "scenario_id,dataset,n_agents\ns1,d,3\ns2,d,2.6\n")
    return tmp_path, put


def rows(d, *order):
    return [tuple(r) for r in d.orderBy(*order).collect()]


def test_loads_and_replaces(spark, folder):
    path, put = folder
    s = store.Store(spark, f"file://{path}/store")
    assert not s.exists("metrics") and s.table("metrics").count() == 0
    assert s.load_folder(f"file://{path}/in") == {"runs": 2, "features": 2, "metrics": 3}
    assert rows(s.table("metrics").select("run_id", "scenario_id", "collision", "min_ttc", "ade"), "run_id", "scenario_id") == [("a", "s1", 1, 0.5, None), ("a", "s2", None, None, None), ("b", "s1", 0, None, None)]
    assert s.table("metrics").columns == s.schema("metrics").names and s.exists("metrics")
    assert rows(s.table("features").select("scenario_id", "n_agents", "split"), "scenario_id") == [("s1", 3, store.split_name("s1")), ("s2", 3, store.split_name("s2"))]
    put("metrics.csv", "run_id,scenario_id,status\na,s9,ok\n")
    put("features.csv", "scenario_id,dataset,n_agents\ns2,d,7\ns3,d,1\n")
    assert s.load_folder(f"file://{path}/in") == {"runs": 2, "features": 2, "metrics": 1}
    assert rows(s.table("metrics").select("run_id", "scenario_id"), "run_id", "scenario_id") == [("a", "s9"), ("b", "s1")]
    assert rows(s.table("features").select("scenario_id", "n_agents"), "scenario_id") == [("s1", 3), ("s2", 7), ("s3", 1)]
    with pytest.raises(FileNotFoundError):
        s.load_folder(f"file://{path}/store")


def test_refusals_and_warnings(spark, folder):
    path, put = folder
    s = store.Store(spark, f"file://{path}/store")
    at = lambda name: f"file://{path}/in/{name}"
    with pytest.warns(UserWarning, match="has no run"):
        s.load_metrics(at("metrics.csv"))
    put("m2.csv", "run_id,scenario_id,status,novel\na,s1,ok,1\n")
    with pytest.warns(UserWarning, match="novel"):
        s.load_metrics(at("m2.csv"))
    put("f2.csv", "scenario_id,dataset,split\ns1,d,discovery\n")
    with pytest.warns(UserWarning, match="split is ignored"):
        s.load_features(at("f2.csv"))
    assert s.table("features").first()["split"] == store.split_name("s1")
    for text in ("run_id,scenario_id\na,s1\n", "run_id,scenario_id,status\na,s1,ok\na,s1,ok\n"):
        put("m3.csv", text)
        with pytest.raises(ValueError):
            s.load_metrics(at("m3.csv"))
    for bad in ("one", "99999999999"):
        put("m4.csv", f"run_id,scenario_id,status,collision\na,s1,ok,{bad}\n")
        with pytest.raises(Exception, match="no int"):
            s.load_metrics(at("m4.csv"))
    other = {"discovery": "confirmation", "confirmation": "discovery"}
    s.replace("features", s._stored("features").replace(other, subset=["split"]))
    with pytest.raises(ValueError, match="differs from the rule"):
        s.load_features(at("f2.csv"))


def test_one_bad_file_does_not_keep_others_out(spark, folder):
    path, put = folder
    put("metrics_2.csv", "run_id\nx\n")
    loaded, errors = store.Store(spark, f"file://{path}/store").load_files(f"file://{path}/in")
    assert loaded == {"runs.csv": 2, "features.csv": 2, "metrics.csv": 3} and list(errors) == ["metrics_2.csv"]


def test_sinks(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    d = spark.createDataFrame([(f"s{i}", ("discovery", "confirmation")[i % 2], "ab"[i % 4 // 2], float(i % 4 >= 2 and i % 3 == 0)) for i in range(400)], "scenario_id string, split string, kind string, y double")
    found = miner.search(d, ["kind"], "y", n_boot=100, depth=1)
    for _ in range(2):  # a job that is saved again replaces itself
        n = s.save_mining("j1", "r", found.classes, found.job, "2024-05-01 00:00:00")
        assert s.table("failure_classes").count() == n == found.classes.count() and s.table("mining_jobs").count() == 1
    assert s.table("mining_jobs").first()["n_candidates_tested"] == found.job["n_candidates_tested"]
    infinite = s.table("failure_classes").where("isnan(conf_lift) OR conf_lift_hi = double('inf')")
    assert infinite.count() == 0
    base = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "scenario_id long, collision double")
    s.save_gate("g1", "x", "y", gate.gate(base, base.limit(20), ["collision"], seed=1, n_boot=50))
    assert rows(s.table("gate_results").select("gate_id", "scope", "verdict"), "scope") == [("g1", "overall", "inconclusive")]
    s.export_csv("gate_results", f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first()["delta"] == "0.00000"


def test_picked_runs(spark):
    runs = spark.createDataFrame([("a", "2024-01-01", "base", "p", "reactive"), ("b", "2024-01-03", "new", "p", "reactive"), ("c", "2024-01-02", "base", "p", "log_replay")], "run_id string, created string, config_name string, planner string, agent_mode string")
    runs = runs.selectExpr("*", "CAST(created AS timestamp_ntz) AS created_at")
    got = lambda **k: {r["role"]: (r["run_id"], r["mismatch"]) for r in report.picked_runs(runs, **k).collect()}
    assert got() == {"primary": ("b", False), "reactive": ("b", False), "log_replay": ("c", True)}
    assert got(job_run="a") == {"primary": ("a", False), "reactive": ("a", False), "log_replay": ("c", False)}
    assert got(gate_run="c")["primary"] == ("c", False) and report.picked_runs(runs.limit(0)).count() == 0


def test_quoted_fields(spark, folder):
    """Quotes in quoted fields are doubled; commas and line ends in them stay."""
    path, put = folder
    s = store.Store(spark, f"file://{path}/store")
    config = '{"a": 1, "b": "x,y", "c": "two\nlines \\\\ back"}'
    put("runs.csv", "run_id,created_at,config_name,config_json,agent_mode,planner,dataset,hardware\na,2024-01-01 00:00:00,base,\"" + config.replace('"', '""') + '",reactive,p,d,"8 cores, ""big"""\nb,2024-01-01 00:00:00,base,,reactive,p,d,\n')
    assert s.load_runs(f"file://{path}/in/runs.csv") == 2
    assert rows(s.table("runs").select("run_id", "config_json", "hardware"), "run_id") == [("a", config, '8 cores, "big"'), ("b", None, None)]
    s.load_metrics(f"file://{path}/in/metrics.csv")
    s.load_features(f"file://{path}/in/features.csv")
    one = lambda name: spark.range(1).select(*[(F.lit('say "x", y') if f.dataType.simpleString() == "string" else F.lit("2024-05-06 07:08:09" if "timestamp" in f.dataType.simpleString() else "3")).cast(f.dataType).alias(f.name) for f in s.schema(name)])
    for name in ("failure_classes", "mining_jobs", "gate_results"):
        s.replace(name, one(name))
    for name in store.TABLES:
        s.export_csv(name, f"file://{path}/out/{name}")
        back = store.read_csv(spark, f"file://{path}/out/{name}", s.schema(name), line_ends=True)
        order = s.schema(name).names
        assert rows(back, *order) == rows(s.table(name), *order) and back.count() > 0


def test_features_are_replaced_by_bucket(spark, folder):
    path, put = folder
    s = store.Store(spark, f"file://{path}/store")
    put("f.csv", "scenario_id,dataset,n_agents\n" + "".join(f"s{i},d,{i}\n" for i in range(500)))
    assert s.load_features(f"file://{path}/in/f.csv") == 500
    before = {x for x in (path / "store" / "features").rglob("*.parquet")}
    put("g.csv", "scenario_id,dataset,n_agents\ns7,d,1000\n")
    assert s.load_features(f"file://{path}/in/g.csv") == 1
    after = {x for x in (path / "store" / "features").rglob("*.parquet")}
    assert len({x.parent for x in before - after}) == 1  # one bucket was written anew
    assert s.table("features").count() == 500 and s.table("features").where("scenario_id = 's7'").first()["n_agents"] == 1000
