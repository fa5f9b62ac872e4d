"""The failure-class miner: beam search over conjunctions of readable predicates on the discovery half, exact tests on the other.

Each half is reduced to its distinct predicate patterns (which predicates hold), with rows and failures, in one aggregation. Rules are
counted on patterns by matrix products, block by block of patterns, so a level is one pass over them; the driver holds rules
and their counts only, at most beam width times predicates of a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.functions.stats import benjamini_hochberg, excludes, wilson, with_fisher, with_rate_ratio

from .predicates import Predicate, conjunction, rule_json, rule_text

MAX_VALUES, MIN_ROWS, MAX_DISTINCT = 12, 10, 8
#: Patterns of a block, and rules that are counted together.
PATTERNS, RULES = 4096, 1024
# Names of the halves; columns that are outcomes or names and so never part of a rule.
HALVES = ("discovery", "confirmation")
EXCLUDED = ("scenario_id", "run_id", "split", "dataset", "status")


def candidate_predicates(df: DataFrame, columns: list[str], excluded: tuple[str, ...] = EXCLUDED) -> list[Predicate]:
    """Predicates of each column: equality with a string's most frequent values; thresholds of a number, which are all but the
    least of few distinct whole values, of whatever type, else tertiles of finite values rounded to one place; NULL tests where some but not all values
    are NULL. Strings that all read as numbers are numbers. Constants give none."""
    types, out = {f.name: f.dataType for f in df.schema}, []
    columns = [c for c in columns if c not in excluded]
    numbers = [c for c in columns if isinstance(types[c], (T.NumericType, T.StringType))]
    value = {c: F.col(f"`{c}`").try_cast("double") if isinstance(types[c], T.StringType) else F.col(f"`{c}`").cast("double") for c in numbers}
    finite = {c: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for c, v in value.items()}
    sums = [F.count(F.col(f"`{c}`")).alias(f"{c}__n") for c in columns]
    sums += [x for c, v in value.items() for x in (F.count_if(v.isNotNull() & ~F.isnan(v)).alias(f"{c}__read"), F.count_if(finite[c] != F.rint(finite[c])).alias(f"{c}__parts"))]
    edges = [F.percentile(finite[c], F.array(F.lit(1 / 3), F.lit(2 / 3))).alias(f"{c}__e") for c in numbers]
    bounds = [F.struct(F.min(finite[c]), F.max(finite[c])).alias(f"{c}__b") for c in numbers]
    stats = df.agg(F.count(F.lit(1)).alias("__all"), *sums, *edges, *bounds).first()
    for c in columns:
        n = stats[f"{c}__n"]
        if n and c in numbers and (isinstance(types[c], T.NumericType) or stats[f"{c}__read"] == n):
            low, high = stats[f"{c}__b"]
            exact = types[c] if isinstance(types[c], T.IntegralType) else T.DoubleType()
            few = sorted(r[0] for r in df.select(finite[c].cast(exact)).where(finite[c].isNotNull()).distinct().limit(MAX_DISTINCT + 1).collect()) if not stats[f"{c}__parts"] else []
            cuts = few[1:] if 0 < len(few) <= MAX_DISTINCT else sorted({round(x, 1) for x in stats[f"{c}__e"] or () if low < round(x, 1) <= high})
            out += [Predicate(c, op, x) for x in cuts for op in (">=", "<")]
        elif n and isinstance(types[c], T.StringType):
            found = df.where(F.col(f"`{c}`").isNotNull()).groupBy(c).count().where(F.col("count") >= MIN_ROWS).orderBy(F.desc("count"), c).limit(MAX_VALUES).collect()
            constant = n == stats["__all"] and len(found) == 1 and found[0][1] == n
            out += [] if constant else [Predicate(c, "=", r[0]) for r in found]
        if 0 < n < stats["__all"]:
            out += [Predicate(c, "IS NULL"), Predicate(c, "IS NOT NULL")]
    return out


def patterns(df: DataFrame, predicates: list[Predicate], target: str) -> DataFrame:
    """(split, bits, n, k, mark): each half's distinct patterns, a character a predicate, with rows, failures and a hash."""
    bits = F.concat(*[F.when(conjunction(df, (p,)), "1").otherwise("0") for p in predicates])
    d = df.groupBy("split", bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("k"))
    return d.withColumn("mark", F.xxhash64("bits"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Predicates that hold (a row a pattern), and weights: rows, failures, and two parts of the hash, whose sums are exact."""
    for batch in batches:
        for at in range(0, len(batch), PATTERNS):
            part = batch.iloc[at : at + PATTERNS]
            held = np.frombuffer("".join(part["bits"]).encode(), np.uint8).reshape(len(part), -1) == ord("1")
            mark = part["mark"].to_numpy(np.int64)
            yield held, np.stack([part["n"], part["k"], mark & 0x3FFFFFFF, (mark >> 30) & 0x3FFFFFFF]).astype(np.float64)


def _covers(held: np.ndarray, rules: list[tuple[int, ...]]) -> np.ndarray:
    out = np.ones((len(held), len(rules)), np.float32)
    for place in range(max(map(len, rules), default=0)):
        own = [i for i, r in enumerate(rules) if len(r) > place]
        out[:, own] *= held[:, [rules[i][place] for i in own]]
    return out


def count_rules(half: DataFrame, rules: list[tuple[int, ...]]) -> np.ndarray:
    """A row a rule: rows, failures, and a fingerprint of the patterns that it covers, in two numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(rules), 4), np.int64)
        for held, weights in _blocks(batches):
            for at in range(0, len(rules), RULES):
                total[at : at + RULES] += (weights @ _covers(held, rules[at : at + RULES])).T.astype(np.int64)
        yield pd.DataFrame(np.column_stack([np.arange(len(rules)), total]), columns=["rule", "n", "k", "a", "b"])

    found = half.mapInPandas(count, "rule long, n long, k long, a long, b long").groupBy("rule").agg(*[F.sum(c).alias(c) for c in "nkab"]).toPandas()
    out = np.zeros((len(rules), 4), np.int64)
    if len(found):
        out[found["rule"]] = found[["n", "k", "a", "b"]]
    return out


def _overlaps(half: DataFrame, rules: list[tuple[int, ...]], with_: list[np.ndarray]) -> list[np.ndarray]:
    """For each rule, the rows that it shares with each rule numbered in with_."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(len(w), np.int64) for w in with_]
        for held, weights in _blocks(batches):
            covers = _covers(held, rules)
            for at in range(0, len(rules), RULES):
                shared = (covers[:, at : at + RULES] * weights[0][:, None].astype(np.float32)).T.astype(np.float64) @ covers
                for i, row in enumerate(shared):
                    total[at + i] += row[with_[at + i]].astype(np.int64)
        yield pd.DataFrame({"rule": np.arange(len(rules)), "shared": [t.tolist() for t in total]})

    rows = half.mapInPandas(count, "rule long, shared array<long>").select("rule", F.posexplode("shared").alias("at", "n")).groupBy("rule", "at").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(len(w), np.int64) for w in with_]
    for rule, at, n in zip(rows["rule"], rows["at"], rows["n"], strict=True):
        out[rule][at] = n
    return out


def pruned(half: DataFrame, rules: list[tuple[int, ...]], sizes: np.ndarray, threshold: float) -> list[int]:
    """Numbers of the rules, best first, that stay when a rule goes whose rows are, to a share of threshold of both, those of a better one that
    stays."""
    earlier = [np.flatnonzero((np.minimum(sizes[:i], sizes[i]) >= threshold * np.maximum(sizes[:i], sizes[i])) & (sizes[:i] > 0)) for i in range(len(rules))]
    shared = _overlaps(half, rules, earlier)
    kept = np.zeros(len(rules), bool)
    for i, (js, n) in enumerate(zip(earlier, shared, strict=True)):
        kept[i] = not (kept[js] & (n >= threshold * np.maximum(sizes[js], sizes[i]))).any()
    return np.flatnonzero(kept).tolist()


@dataclass
class Mined:
    """A mining job: classes (a row a class), and its counters."""

    classes: DataFrame
    job: dict
    rules: dict[str, tuple[Predicate, ...]] = field(default_factory=dict)
    confirmation: DataFrame | None = None
    predicates: list[Predicate] = field(default_factory=list)

    def union_mass_share(self, k: int = 3, ranking: str = "wracc") -> tuple[float, int]:
        """The share of the confirmation half's failures that the first k classes of a ranking hold together, and their number."""
        failures = self.job["conf_failures"]
        if not failures:
            return float("nan"), 0
        first = [self.rules[r[0]] for r in self.classes.where(F.col(f"rank_{ranking}") <= k).select("rule").collect()]
        at = {p: i for i, p in enumerate(self.predicates)}
        any_ = F.lit(False)
        for rule in first:
            one = F.lit(True)
            for p in rule:
                one = one & (F.substring("bits", at[p] + 1, 1) == "1")
            any_ = any_ | one
        n = self.confirmation.where(any_).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        return n / failures, n


def _wracc(n: np.ndarray, k: np.ndarray, n_all: int, k_all: int) -> np.ndarray:
    return (n / n_all) * (k / np.maximum(n, 1) - k_all / n_all)


def _lift(n: np.ndarray, k: np.ndarray, n_all: int, k_all: int) -> np.ndarray:
    """Rate against the complement's; where that has no failure, 1e6 and the rate, so that such rules keep their order."""
    rate, rest_n, rest_k = k / np.maximum(n, 1), n_all - n, k_all - k
    ratio = np.where(rest_k > 0, rate * np.maximum(rest_n, 1) / np.maximum(rest_k, 1), 1e6 + rate)
    return np.where(rest_n > 0, ratio, 0.0)


QUALITIES = {"wracc": _wracc, "lift": _lift}


def search(df: DataFrame, columns: list[str], target: str, *, beam: int = 50, depth: int = 3, min_support: int = 30, alpha: float = 0.05, n_boot: int = 10_000, seed: int = 0, quality: str = "wracc", redundancy: float = 0.9, max_pruned: int = 2000, max_classes: int = 200) -> Mined:
    """Failure classes of df: scenario_id, split (discovery or confirmation), target (0 or 1; NULL rows don't count) and feature columns.

    Discovery: rules of up to depth predicates, each level the beam best of the last with one predicate more; rules that cover the
    same rows count once, the shortest first. Every rule with min_support discovery rows is counted on the other half; those with a row
    there are the correction's family. The report has rules with min_support confirmation rows in order of WRAcc on that half, without those
    that all but repeat a better one (redundancy of both), the first max_classes and every one of q below alpha after them.
    significant: q below alpha and the lift interval above 1.

    Raises if a target has other values, a half is empty, a split has another name, or no rule can be tested.
    """
    if quality not in QUALITIES or not 0 < alpha < 1 or min_support < 1 or depth < 1:
        raise ValueError("need a known quality, alpha within (0, 1), min_support and depth of at least 1")
    d = df.select("scenario_id", "split", F.col(target).cast("double").alias(target), *[c for c in columns if c != target]).persist()
    try:
        return _search(d, columns, target, beam, depth, min_support, alpha, n_boot, seed, quality, redundancy, max_pruned, max_classes)
    finally:
        d.unpersist()


def _search(d: DataFrame, columns: list[str], target: str, beam: int, depth: int, min_support: int, alpha: float, n_boot: int, seed: int, quality: str, redundancy: float, max_pruned: int, max_classes: int) -> Mined:  # noqa: PLR0913
    odd = d.where(F.col(target).isNotNull() & ~F.col(target).isin(0.0, 1.0)).select(target).limit(5).collect()
    if odd:
        raise ValueError(f"{target} has values other than 0 and 1: {[r[0] for r in odd]}")
    halves = {r["split"]: r for r in d.groupBy("split").agg(F.count(target).alias("n"), F.coalesce(F.sum(target), F.lit(0.0)).cast("long").alias("k"), F.count(F.lit(1)).alias("rows")).collect()}
    if set(halves) - set(HALVES):
        raise ValueError(f"unknown split {sorted(map(str, set(halves) - set(HALVES)))}")
    if any(h not in halves or not halves[h]["n"] for h in HALVES):
        raise ValueError("both halves need rows with a target: nothing can be reported from one")
    (disc_n, disc_k), (conf_n, conf_k) = ((halves[h]["n"], halves[h]["k"]) for h in HALVES)
    d = d.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("long"))
    predicates = candidate_predicates(d.where(F.col("split") == HALVES[0]), [c for c in columns if c != target])
    if not predicates:
        raise ValueError("no predicate can be made of the columns")
    held = patterns(d, predicates, target).persist()
    held.count()  # the patterns outlive the rows they are of
    discovery, confirmation = (held.where(F.col("split") == h) for h in HALVES)

    seen, front, found, thin, repeated = set(), [()], [], 0, 0
    for _ in range(depth):
        rules = sorted({tuple(sorted({*r, i})) for r in front for i in range(len(predicates)) if i not in r})
        counts = count_rules(discovery, rules)
        scored = []
        for rule, (n, k, a, b) in zip(rules, counts.tolist(), strict=True):
            if n < min_support:
                thin += 1
            elif (n, k, a, b) in seen:
                repeated += 1
            else:
                seen.add((n, k, a, b))
                scored.append((rule, n, k))
        if not scored:
            break
        marks = QUALITIES[quality](np.array([x[1] for x in scored]), np.array([x[2] for x in scored]), disc_n, disc_k)
        front = [scored[i][0] for i in np.argsort(-marks, kind="stable")[:beam]]
        found += [(*x, float(q)) for x, q in zip(scored, marks, strict=True)]
    counts = count_rules(confirmation, [x[0] for x in found])
    tested = [(x, int(n), int(k)) for x, (n, k, *_) in zip(found, counts.tolist(), strict=True) if n]
    if not tested:
        raise ValueError("no rule has enough rows in both halves")
    names = {r: tuple(predicates[i] for i in r) for r, *_ in found}

    rows = [(i, rule_text(names[r]), rule_json(names[r]), len(r), q, n, k, cn, ck, conf_n - cn, conf_k - ck) for i, ((r, n, k, q), cn, ck) in enumerate(tested)]
    schema = "number int, rule string, rule_json string, depth int, quality double, disc_n long, disc_failures long, conf_n long, conf_failures long, rest_n long, rest_failures long"
    spark = d.sparkSession
    family = benjamini_hochberg(with_fisher(spark.createDataFrame(rows, schema), "conf_failures", "conf_n", "rest_failures", "rest_n"), alpha=alpha).drop("rejected").toPandas().sort_values("number")
    n, k = family["conf_n"].to_numpy(), family["conf_failures"].to_numpy()
    gain, lift = _wracc(n, k, conf_n, conf_k), _lift(n, k, conf_n, conf_k)
    lift = np.where(conf_k - k > 0, lift, -np.inf)  # no lift where the complement has no failure: last of equal gains
    order = [i for i in np.lexsort((family["depth"], -lift, -gain)) if n[i] >= min_support]
    pool = order[:max_pruned]
    kept = [pool[i] for i in pruned(confirmation, [tested[i][0][0] for i in pool], n[pool], redundancy)] if pool else []
    q = family["q_value"].to_numpy()
    final = kept[:max_classes] + [i for i in kept[max_classes:] if q[i] < alpha]
    place = {int(i): at for at, i in enumerate(final)}
    shown = family.iloc[final].assign(place=[place[i] for i in final])
    schema += ", p_value double, q_value double, place int"
    classes = _reported(spark.createDataFrame(shown[[x.split()[0] for x in schema.split(", ")]].to_dict("records"), schema), disc_n, disc_k, conf_n, conf_k, len(tested), alpha, n_boot, seed)
    job = {
        "target": target, "alpha": alpha, "n_bootstrap": n_boot, "beam_width": beam, "max_depth": depth, "min_coverage": min_support, "quality": quality, "seed": seed,
        "n_scenarios": disc_n + conf_n, "n_target_null": sum(h["rows"] - h["n"] for h in halves.values()), "disc_n": disc_n, "disc_failures": disc_k, "conf_n": conf_n, "conf_failures": conf_k,
        "n_predicates": len(predicates), "n_candidates_tested": len(tested), "n_raw_significant": int((family["p_value"] < alpha).sum()), "n_low_coverage_skipped": thin,
        "n_duplicate_coverage_skipped": repeated, "n_no_confirmation_coverage": len(found) - len(tested), "n_pruned_redundant": len(pool) - len(kept),
        "n_beyond_pruning": len(order) - len(pool), "expected_false_positives": alpha * len(tested),
    }
    return Mined(classes, job, {rule_text(names[x[0]]): names[x[0]] for x in found}, confirmation, predicates)


def _reported(shown: DataFrame, disc_n: int, disc_k: int, conf_n: int, conf_k: int, n_tested: int, alpha: float, n_boot: int, seed: int) -> DataFrame:
    """The classes' rates, lifts, intervals, ranks and reasons."""
    low, high = wilson(F.col("conf_failures"), F.col("conf_n"), alpha, contain=True)
    rate = lambda k, n: F.try_divide(k, n)
    d = with_rate_ratio(shown, "conf_failures", "conf_n", "rest_failures", "rest_n", F.lit(seed + 1000) + F.col("place"), "ratio", alpha=alpha, n_boot=n_boot)
    d = d.select(
        "rule", "rule_json", "depth", "quality", "disc_n", "disc_failures", rate("disc_failures", "disc_n").alias("disc_rate"),
        F.try_divide(rate("disc_failures", "disc_n"), rate(disc_k - F.col("disc_failures"), disc_n - F.col("disc_n"))).alias("disc_lift"),
        "conf_n", "conf_failures", rate("conf_failures", "conf_n").alias("conf_rate"), low.alias("conf_rate_lo"), high.alias("conf_rate_hi"),
        F.nanvl("ratio.point", F.lit(None).cast("double")).alias("conf_lift"), F.col("ratio.lo").alias("conf_lift_lo"), F.col("ratio.hi").alias("conf_lift_hi"), F.col("ratio.method").alias("lift_method"),
        F.lit(conf_k / conf_n).alias("base_rate"), rate("conf_failures", F.nullif(F.lit(conf_k), F.lit(0))).alias("failure_mass_share"),
        (F.col("conf_n") / conf_n * (rate("conf_failures", "conf_n") - conf_k / conf_n)).alias("conf_wracc"), "p_value", "q_value",
    )
    clears, sharp = F.col("q_value") < alpha, excludes(F.col("conf_lift_lo"), F.col("conf_lift_hi"), 1.0)
    d = d.withColumn("significant", clears & sharp & (F.col("conf_lift_lo") > 1.0))
    q = F.format_string("q = %.3g", "q_value")
    reason = F.when(F.col("significant"), F.concat(q, F.lit(f" is below {alpha} among {n_tested} tested rules, and the lift interval lies above 1")))
    reason = reason.when(clears & ~sharp, F.concat(q, F.lit(f" is below {alpha}, but the lift interval holds 1: reported, not claimed")))
    reason = reason.when(clears, F.concat(q, F.lit(f" is below {alpha}, but the lift interval lies below 1, where the miner does not search")))
    reason = reason.when(F.col("p_value") < alpha, F.concat(q, F.lit(f" is not below {alpha} among {n_tested} tested rules, though the uncorrected p-value is")))
    d = d.withColumn("reason", reason.otherwise(F.concat(q, F.lit(f" is not below {alpha}"))))
    orders = {"mass": ("failure_mass_share", "conf_lift"), "lift": ("conf_lift", "failure_mass_share"), "wracc": ("conf_wracc", "conf_lift")}
    rank = lambda a, b: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(a), F.desc_nulls_last(b), "depth", "rule"))
    return d.withColumns({f"rank_{name}": rank(*by) for name, by in orders.items()})


def joined(features: DataFrame, metrics: DataFrame, target: str) -> DataFrame:
    """features with the target of their scenarios, one to one. Raises if a scenario is twice on either side, metrics are of more than one run, or
    nothing is in both."""
    if "run_id" in metrics.columns:
        runs = [r[0] for r in metrics.where(F.col("run_id").isNotNull()).select("run_id").distinct().limit(5).collect()]
        if len(runs) > 1:
            raise ValueError(f"metrics of several runs can't be mined together: {sorted(map(str, runs))}")
    for name, d in (("features", features), ("metrics", metrics)):
        bad = d.groupBy("scenario_id").count().where("count > 1").limit(3).collect()
        if bad:
            raise ValueError(f"scenarios are twice in {name}: {[r[0] for r in bad]}")
    out = features.join(metrics.select("scenario_id", target), "scenario_id")
    if out.isEmpty():
        raise ValueError("features and metrics share no scenario")
    return out


def mine(df: DataFrame, columns: list[str], target: str, **options) -> DataFrame:
    """search()'s classes."""
    return search(df, columns, target, **options).classes
