"""Exact quantiles of groups of any size: values are counted and sorted by range, and a task holds a range of them, never a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.sources.work import kept


def with_few(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, which has a row or a few for each of keys; NULL keys meet NULL."""
    of = {k: f"__of_{k}" for k in keys}
    found = right.select(*[F.col(k).alias(of[k]) for k in keys], *[c for c in right.columns if c not in of])
    return left.join(F.broadcast(found), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(of[k])) for k in keys)), how).drop(*of.values())


def quantiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(*keys, a double for each name in qs): the quantile of value in each group, interpolated between the two order statistics about q (n - 1). NULLs don't count;
    groups without a value are left out.

    A value's rank is its place in its range, and how many come before that range. The ranges are those of one work table, as a second sort may cut elsewhere.
    """
    c, at = F.col, [*keys, "__part"]
    counted = rows.where(c(value).isNotNull()).groupBy(*keys, c(value).cast("double").alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    counted = kept(counted.repartitionByRange(*keys, "__value").withColumn("__part", F.spark_partition_id()), "quantiles")
    whole = Window.partitionBy(*keys)
    parts = counted.groupBy(*at).agg(F.sum("__n").alias("__size"))
    parts = parts.withColumns({"__end": F.sum("__size").over(whole.orderBy("__part")), "__all": F.sum("__size").over(whole)}).withColumn("__begin", c("__end") - c("__size"))
    place = {name: F.lit(q) * (c("__all") - 1) for name, q in qs.items()}
    ranks = [r for p in place.values() for r in (F.floor(p), F.least(F.floor(p) + 1, c("__all") - 1))]
    # Only ranges that hold a wanted rank are read again.
    wanted = parts.where(reduce(lambda a, b: a | b, ((r >= c("__begin")) & (r < c("__end")) for r in ranks)))
    d = with_few(counted, wanted.select(*at, "__begin", "__all"), at)
    d = d.withColumn("__upto", c("__begin") + F.sum("__n").over(Window.partitionBy(*at).orderBy("__value")))
    one = lambda r: F.max(F.when((r >= c("__upto") - c("__n")) & (r < c("__upto")), c("__value")))
    between = lambda p, low, high: (low + (high - low) * (p - F.floor(p)))
    found = d.groupBy(*keys).agg(F.max("__all").alias("__all"), *[one(r).alias(f"__{i}") for i, r in enumerate(ranks)])
    return found.select(*keys, *[between(p, c(f"__{2 * i}"), c(f"__{2 * i + 1}")).alias(name) for i, (name, p) in enumerate(place.items())])
