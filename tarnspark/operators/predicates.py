"""Predicates over features, and conjunctions of them, as Columns. NULL and NaN satisfy only `IS NULL`, or no comparison."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operators of a predicate.
OPERATORS = (">=", "<", "=", "IS NULL", "IS NOT NULL")


def number_text(x: float) -> str:
    """A threshold as rules show it: whole numbers without decimals, others with one."""
    return str(int(x)) if float(x).is_integer() else f"{x:.1f}"


@dataclass(frozen=True, order=True)
class Predicate:
    column: str
    op: str
    value: float | str | None = None

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")
        if self.op.startswith("IS") and self.value is not None:
            raise ValueError(f"{self.op} takes no value")

    def on(self, df: DataFrame) -> Column:
        if self.column not in df.columns:
            raise ValueError(f"no column {self.column}")
        c = F.col(f"`{self.column}`")
        if self.op == "IS NULL":
            return c.isNull()
        if self.op == "IS NOT NULL":
            return c.isNotNull()
        if self.op == "=":
            return F.coalesce(c.cast("string") == str(self.value), F.lit(False))
        number = c.try_cast("double")
        held = number >= float(self.value) if self.op == ">=" else number < float(self.value)
        return F.coalesce(held & ~F.isnan(number), F.lit(False))

    def __str__(self) -> str:
        if self.value is None:
            return f"{self.column} {self.op}"
        return f"{self.column} {self.op} {self.value if self.op == '=' else number_text(self.value)}"


def conjunction(df: DataFrame, rule: tuple[Predicate, ...]) -> Column:
    return reduce(lambda a, b: a & b, (p.on(df) for p in sorted(rule, key=str)), F.lit(True))


def rule_text(rule: tuple[Predicate, ...]) -> str:
    return " AND ".join(sorted(map(str, rule)))


def rule_json(rule: tuple[Predicate, ...]) -> str:
    """The rule as JSON, a list of its predicates in the order of their texts."""
    return json.dumps([{"column": p.column, "op": p.op, "value": p.value} for p in sorted(rule, key=str)])


def rule_from_json(text: str) -> tuple[Predicate, ...]:
    return tuple(Predicate(**p) for p in json.loads(text))


def scopes_from_rules(features: DataFrame, rules: list[tuple[Predicate, ...]], prefix: str = "", limit: int | None = None) -> DataFrame:
    """(scope, scope_index, scenario_id): the scenarios of both halves that each rule holds for; a scope has the name of its rule."""
    held = [F.when(conjunction(features, r), F.struct(F.lit(prefix + rule_text(r)).alias("scope"), F.lit(i + 1).alias("scope_index"))) for i, r in enumerate(rules[:limit])]
    if not held:
        return features.select(F.lit("").alias("scope"), F.lit(0).alias("scope_index"), "scenario_id").limit(0)
    return features.select("scenario_id", F.explode(F.array_compact(F.array(*held))).alias("s")).select("s.scope", "s.scope_index", "scenario_id")


def rule_counts(df: DataFrame, rules: list[tuple[Predicate, ...]], target: str) -> DataFrame:
    """Coverage, failures, rate and weighted relative accuracy of every rule, in one pass; rows of NULL target don't count."""
    d = df.where(F.col(target).isNotNull())
    y = F.col(target).cast("long")
    held = [conjunction(df, r) for r in rules]
    sums = [x for i, h in enumerate(held) for x in (F.count(F.when(h, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(h, y)), F.lit(0)).alias(f"k{i}"))]
    one = d.agg(F.count(F.lit(1)).alias("n_all"), F.sum(y).alias("k_all"), *sums)
    rows = F.array(*[F.struct(F.lit(rule_text(r)).alias("rule"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k")) for i, r in enumerate(rules)])
    flat = one.select("n_all", "k_all", F.explode(rows).alias("r")).select("r.*", "n_all", "k_all")
    rate, base = F.try_divide("k", "n"), F.try_divide("k_all", "n_all")
    return flat.select("rule", "n", "k", rate.alias("rate"), (F.col("n") / F.col("n_all") * (rate - base)).alias("wracc"))
