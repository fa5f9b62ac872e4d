"""The miner's family, pruning, rankings and refusals, on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnspark.functions import stats
from tarnspark.operators import miner
from tarnspark.operators.predicates import Predicate, rule_from_json, rule_text


@pytest.fixture(scope="module")
def planted(spark):
    rng, rows = random.Random(3), []
    for i in range(1800):
        kind, half = f"k{rng.randrange(6)}", "discovery" if i % 2 else "confirmation"
        rows.append((f"s{i}", half, kind, kind.upper(), rng.choice([None, 1, 2, 3]), "only" if i < 300 and half == "discovery" else "both", float(rng.random() < (0.4 if kind == "k0" else 0.1))))
    return spark.createDataFrame(rows, "scenario_id string, split string, kind string, twin string, level int, place string, y double")


@pytest.fixture(scope="module")
def mined(planted):
    found = miner.search(planted, ["kind", "twin", "level", "place"], "y", depth=2, n_boot=500)
    return found, {r["rule"]: r for r in found.classes.collect()}


def test_the_family_is_every_rule_of_both_halves(planted, mined):
    found, rows = mined
    short = {r["rule"]: r for r in miner.mine(planted, ["kind", "twin", "level", "place"], "y", depth=2, n_boot=500, max_classes=1).collect()}
    assert any(r["conf_wracc"] < 0 for r in rows.values())  # rules that do worse are tested, too
    assert "place = only" not in rows and found.job["n_no_confirmation_coverage"] >= 1
    assert {r: x["q_value"] for r, x in short.items()} == {r: rows[r]["q_value"] for r in short}
    assert set(short) >= {r for r, x in rows.items() if x["significant"]} and len(short) < len(rows)
    assert found.job["n_candidates_tested"] > len(rows) and found.job["expected_false_positives"] == 0.05 * found.job["n_candidates_tested"]


def test_counts_are_exact(planted, mined):
    found, rows = mined
    for text in list(rows)[:8]:
        own = found.rules[text]
        held = planted.where(" AND ".join(f"({p.column} {p.op}" + ("" if p.value is None else f" '{p.value}'" if p.op == "=" else f" {p.value}") + ")" for p in own))
        got = {r["split"]: (r["n"], r["k"]) for r in held.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).collect()}
        r = rows[text]
        assert (r["disc_n"], r["disc_failures"], r["conf_n"], r["conf_failures"]) == (*got["discovery"], *got["confirmation"])
        assert rule_text(rule_from_json(r["rule_json"])) == text == rule_text(own)


def test_rules_of_equal_rows_count_once(mined):
    found, rows = mined
    assert found.job["n_duplicate_coverage_skipped"] > 5  # each kind has a twin
    assert "kind = k0" in rows and "twin = K0" not in rows


def test_the_planted_class_leads(mined):
    found, rows = mined
    top = rows["kind = k0"]
    assert top["rank_wracc"] == 1 and top["significant"] and top["conf_lift_lo"] > 1 and "lies above 1" in top["reason"]
    for name, by in (("mass", "failure_mass_share"), ("lift", "conf_lift"), ("wracc", "conf_wracc")):
        ordered = [r[by] for r in sorted(rows.values(), key=lambda r: r[f"rank_{name}"])]
        assert ordered == sorted(ordered, key=lambda x: -x if x is not None else float("inf"))
        assert sorted(r[f"rank_{name}"] for r in rows.values()) == list(range(1, len(rows) + 1))
    share, n = found.union_mass_share(1)
    assert n == top["conf_failures"] and share == n / found.job["conf_failures"]
    assert found.union_mass_share(10**6)[0] <= 1


def test_near_repeats_are_pruned(planted):
    noisy = planted.withColumn("also", F.when(F.crc32("scenario_id") % 40 == 0, F.lit("other")).otherwise(F.col("kind")))
    loose = miner.search(noisy, ["kind", "also"], "y", depth=1, n_boot=200)
    whole = miner.search(noisy, ["kind", "also"], "y", depth=1, n_boot=200, redundancy=1.01)
    names = {r["rule"] for r in loose.classes.collect()}
    assert loose.job["n_pruned_redundant"] == 6 and len({n[-2:] for n in names}) == len(names)
    assert whole.job["n_pruned_redundant"] == 0


def test_refusals(planted):
    options = {"columns": ["kind"], "target": "y"}
    for bad in (planted.where("split = 'discovery'"), planted.withColumn("split", F.lit("third")), planted.withColumn("y", F.lit(0.5)), planted.limit(0)):
        with pytest.raises(ValueError):
            miner.mine(bad, **options)
    with pytest.raises(ValueError):
        miner.mine(planted.withColumn("kind", F.lit("one")), **options)  # a constant makes no predicate
    with pytest.raises(ValueError):
        miner.mine(planted, **options, min_support=10**6)


def test_features_and_metrics_are_joined_one_to_one(spark):
    features = spark.createDataFrame([("a", 1), ("b", 2)], "scenario_id string, n int")
    metrics = spark.createDataFrame([("r", "a", 1), ("r", "c", 0)], "run_id string, scenario_id string, y int")
    assert [tuple(r) for r in miner.joined(features, metrics, "y").collect()] == [("a", 1, 1)]
    for f, m in ((features.union(features), metrics), (features, metrics.union(metrics)), (features, metrics.replace("c", "d").replace("r", "q").union(metrics)), (features.where("n = 2"), metrics)):
        with pytest.raises(ValueError):
            miner.joined(f, m, "y")


def test_correction_leaves_out_what_is_no_p_value(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", None), ("d", float("nan")), ("e", 1.5)], "name string, p_value double")
    got = {r["name"]: (r["q_value"], r["rejected"]) for r in stats.benjamini_hochberg(d).collect()}
    assert got == {"a": (0.02, True), "b": (0.03, True), "c": (None, False), "d": (None, False), "e": (None, False)}
    with pytest.raises(Exception, match="must lie within"):
        stats.benjamini_hochberg(d, strict=True).collect()


def test_rate_ratios():
    point, low, high, method = stats.rate_ratio(30, 100, 10, 100, seed=4)
    assert point == pytest.approx(3) and method == "bootstrap" and 1.4 < low < 2.2 and 5 < high < 9
    assert stats.rate_ratio(0, 30, 5, 100)[3] == "delta_log_haldane" and stats.rate_ratio(0, 30, 5, 100)[2] > 1
    assert stats.rate_ratio(0, 0, 5, 100)[3] == "undefined_empty_group" and stats.rate_ratio(0, 9, 0, 9)[3] == "undefined_both_zero"
    assert stats.rate_ratio(10, 10, 10, 10, method="delta")[3] == "delta_log_degenerate"
    with pytest.raises(ValueError):
        stats.rate_ratio(5, 4, 0, 1)


def test_kendall():
    assert stats.kendall_tau([1, 2, 3, 4], [4, 3, 2, 1]) == (-1.0, pytest.approx(2 / 24))
    assert stats.kendall_tau([1, 2, 3, 4, 5], [1, 2, 3, 5, 4]) == (pytest.approx(0.8), pytest.approx(2 * 5 / 120))
    tau, p = stats.kendall_tau([1, 1, 2, 3], [1, 2, 2, 3])
    assert tau == pytest.approx(4 / 5) and 0 < p < 1
    assert all(x != x for x in stats.kendall_tau([1, 1], [1, 2]))


def test_number_texts():
    assert str(Predicate("x", ">=", 5000.0)) == "x >= 5000" and str(Predicate("x", "<", 0.25)) == "x < 0.2" and str(Predicate("c", "=", "1-URGENT")) == "c = 1-URGENT"
    with pytest.raises(ValueError):
        Predicate("x", "IS NULL", 1)
