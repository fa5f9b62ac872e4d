"""Bootstrap by Poisson weights: each unit's weight in each replicate is drawn from a hash of the unit, so that replicates are sums,
which tasks add up in part and no task needs a cell's rows together.

Units of equal values in a cell are one row with a multiplicity: the weights of m units add up to a Poisson draw of mean m, so the work goes by
distinct values, and that of flags is the same however many scenarios there are. Statistics that are no function of sums (quantiles) take
the weights of a cell's distinct values, a block of replicates at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.quantiles import quantiles, with_few
from tarnspark.sources.work import kept

#: Weights drawn at once, and cells held before their sums are given on.
DRAWN, CELLS = 1_000_000, 200
#: Replicates that one task draws for a statistic of values.
REPLICATES = 100
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def poisson_weights(marks: np.ndarray, n_boot: int) -> np.ndarray:
    """(unit, replicate) weights of mean 1 by the units' 64-bit hashes."""
    x = marks.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, n_boot + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_CDF, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def drawn_weights(marks: np.ndarray, times: np.ndarray, n_boot: int) -> np.ndarray:
    """(row, replicate) weights of mean `times`, by the rows' 64-bit hashes."""
    out = poisson_weights(marks, n_boot)
    for i in np.flatnonzero(times != 1):
        out[i] = np.random.Generator(np.random.Philox(key=int(marks[i]) % (1 << 64))).poisson(times[i], n_boot)
    return out


def _distinct(units: DataFrame, keys: list[str], seed: Column, values: list[str]) -> DataFrame:
    """Distinct values of each cell's units, with their multiplicity and a hash: *keys, *values, __times, __mark."""
    d = units.withColumn("__seed", seed).groupBy(*keys, *values, "__seed").agg(F.count(F.lit(1)).cast("double").alias("__times"))
    return d.withColumn("__mark", F.xxhash64("__seed", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *values)])).drop("__seed")


def resampled(units: DataFrame, keys: list[str], seed: Column, values: list[str], n_boot: int) -> DataFrame:
    """(*keys, replicate, n_units, *values): weighted sums of each cell and replicate; in replicate 0 each weight is 1. Two cells draw on their own."""
    sums = ["n_units", *values]
    d = _distinct(units.select(*keys, *[c for c in units.columns if c == "__seed"], *[F.col(v).cast("double").alias(v) for v in values]), keys, seed, values)
    d = d.select(*keys, "__mark", "__times", F.lit(1.0).alias("n_units"), *values)
    if n_boot > 0:
        d = d.repartition(2 * units.sparkSession.sparkContext.defaultParallelism, "__mark")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        give = lambda: pd.DataFrame([(*k, *map(list, s)) for k, s in held.items()], columns=[*keys, *sums])
        for batch in batches:
            for key, part in batch.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key not in held and len(held) >= CELLS:
                    yield give()
                    held.clear()
                total = held.setdefault(key, np.zeros((len(sums), n_boot + 1)))
                marks, times, x = part["__mark"].to_numpy(), part["__times"].to_numpy(), part[sums].to_numpy(np.float64)
                total[:, 0] += x.T @ times
                step = max(1, DRAWN // max(1, n_boot))
                for at in range(0, len(marks) if n_boot else 0, step):
                    total[:, 1:] += x[at : at + step].T @ drawn_weights(marks[at : at + step], times[at : at + step], n_boot)
        if held:
            yield give()

    kinds = dict(d.dtypes)
    rows = d.mapInPandas(add, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{s}` array<double>" for s in sums)]))
    flat = rows.select(*keys, F.posexplode(F.arrays_zip(*sums)).alias("replicate", "s")).select(*keys, "replicate", *[F.col(f"s.{s}").alias(s) for s in sums])
    return flat.groupBy(*keys, "replicate").agg(*[F.sum(s).alias(s) for s in sums])


def whole(c: Column) -> Column:
    """An aggregate's argument: c in replicate 0."""
    return F.max(F.when(F.col("replicate") == 0, c))


def drawn(c: Column) -> Column:
    """c in the drawn replicates that have any unit."""
    return F.when((F.col("replicate") > 0) & (F.col("n_units") > 0), c)


def mean(total: Column, n: Column) -> Column:
    return F.try_divide(total, n)


def log_mean(total: Column, n: Column) -> Column:
    """NULL where the mean is not positive, so such draws drop out."""
    return F.when(total > 0, F.log(F.try_divide(total, n)))


@dataclass(frozen=True)
class OverValues:
    """A statistic of a cell's values: of(sorted distinct values, whole weights (value, replicate)) gives one number a replicate, NaN where there is none. q: the quantile that it is, if it
    is one."""

    of: Callable[[np.ndarray, np.ndarray], np.ndarray]
    q: float | None = None


def quantile(q: float) -> OverValues:
    """The q-quantile, interpolated between the two order statistics about q (n - 1)."""

    def of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        upto = np.cumsum(weights, axis=0)
        at = q * (upto[-1] - 1)
        low = np.floor(at)
        pick = lambda k: values[np.minimum((upto <= k).sum(0), len(values) - 1)]
        first, second = pick(low), pick(np.minimum(low + 1, upto[-1] - 1))
        return np.where(upto[-1] > 0, first + (second - first) * (at - low), np.nan)

    return OverValues(of, q)


median = quantile(0.5)

#: A statistic is a function of a cell's sum and number of rows, or of its values.
Statistic = Callable[[Column, Column], Column] | OverValues


def _bounds(c: Column, alpha: float) -> Column:
    return F.percentile(c, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))


def _alone(c: Column, n: str, least: int = 2) -> Column:
    """c, or NaN where there are too few units for a bound."""
    return F.when(F.col(n) >= least, c).otherwise(float("nan"))


def cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, value: str, *, seed: int, n_boot: int = 10_000, alpha: float = 0.05, statistic: Statistic = mean) -> DataFrame:
    """A statistic of value in each cell of keys (by default the mean), with a percentile interval over draws of clusters. NULL values don't
    count; fewer than two clusters give NaN bounds. Clusters are summed up first, then weighted by Poisson draws."""
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(F.col(value).cast("double")).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    of = statistic(F.col("__sum"), F.col("__n"))
    out = resampled(d, keys, F.lit(seed), ["__sum", "__n"], n_boot).groupBy(*keys).agg(
        whole(F.col("n_units")).cast("long").alias("n_clusters"), whole(F.col("__n")).cast("long").alias("n_rows"), whole(of).alias("point"), _bounds(drawn(of), alpha).alias("__ci"),
    )
    bound = lambda i: _alone(F.col("__ci")[i], "n_clusters")
    return out.select(*keys, "n_clusters", "n_rows", "point", bound(0).alias("ci_lo"), bound(1).alias("ci_hi"))


def paired_cluster_bootstrap(df: DataFrame, keys: list[str], cluster: str, a: str, b: str, *, seed: int | Column, n_boot: int = 10_000, alpha: float = 0.05, statistic: Statistic = mean) -> DataFrame:
    """The difference of a statistic, of b less of a, in each cell: *keys, n_clusters, n_paired, first, second, delta, delta_lo, delta_hi and
    p_value. Both arms are drawn together; pairs with a NULL don't count. p_value is twice the smaller share of draws on one side of 0,
    1/n at least. Fewer than two clusters give NaN. seed may be a column of the cells. Without draws (n_boot 0) bounds and p_value are NULL. A statistic
    of values (OverValues) goes by paired_value_bootstrap()."""
    if isinstance(statistic, OverValues):
        return paired_value_bootstrap(df, keys, cluster, a, b, seed=seed, n_boot=n_boot, alpha=alpha, statistic=statistic)
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.withColumn("__seed", seed if isinstance(seed, Column) else F.lit(seed))
    d = d.groupBy(*keys, cluster, "__seed").agg(F.sum(F.col(a).cast("double")).alias("__a"), F.sum(F.col(b).cast("double")).alias("__b"), F.count(F.lit(1)).alias("__n"))
    first, second = statistic(F.col("__a"), F.col("__n")), statistic(F.col("__b"), F.col("__n"))
    of = drawn(second - first)
    n = F.count(of)
    p = F.least(F.lit(1.0), F.greatest(2 * F.least(F.try_divide(F.count_if(of <= 0), n), F.try_divide(F.count_if(of >= 0), n)), F.lit(1 / max(1, n_boot))))
    out = resampled(d, keys, F.col("__seed"), ["__a", "__b", "__n"], n_boot).groupBy(*keys).agg(
        whole(F.col("n_units")).cast("long").alias("n_clusters"), whole(F.col("__n")).cast("long").alias("n_paired"), whole(first).alias("first"), whole(second).alias("second"),
        whole(second - first).alias("delta"), _bounds(of, alpha).alias("__ci"), F.when(n > 0, p).alias("p_value"),
    )
    bound = lambda c: _alone(c, "n_clusters")
    return out.select(*keys, "n_clusters", "n_paired", "first", "second", "delta", bound(F.col("__ci")[0]).alias("delta_lo"), bound(F.col("__ci")[1]).alias("delta_hi"), bound(F.col("p_value")).alias("p_value"))


def paired_value_bootstrap(df: DataFrame, keys: list[str], cluster: str, a: str, b: str, *, seed: int | Column, n_boot: int = 10_000, alpha: float = 0.05, statistic: OverValues) -> DataFrame:
    """paired_cluster_bootstrap()'s rows for a statistic of values, such as a median: both arms take the same weights, and those of a cluster go to all its rows.

    A quantile without draws goes by sorted ranges of values, and no task holds a cell. Else a task draws REPLICATES replicates of a cell and holds the cell's distinct pairs of values (of one-row clusters; else its rows): stored metrics have six
    digits, so these are bounded by the digits, not by the number of scenarios, unless clusters have several rows each.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(cluster).alias("__cluster"), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"), (seed if isinstance(seed, Column) else F.lit(seed)).alias("__seed"))
    if n_boot <= 0 and statistic.q is not None:
        return _paired_quantiles(d, keys, statistic.q)
    rows = F.array_sort(F.collect_list(F.struct("__a", "__b")))
    d = d.groupBy(*keys, "__cluster", "__seed").agg(rows.alias("rows")).groupBy(*keys, "__seed", "rows").agg(F.count(F.lit(1)).alias("__times"))
    d = d.withColumn("__mark", F.xxhash64("__seed", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.to_json("rows"))).drop("__seed")
    # Block 0 holds the whole sample, each further one its share of the draws.
    blocks = math.ceil(n_boot / REPLICATES)
    d = d.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks)))) if blocks else d.withColumn("__block", F.lit(0))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        block, times = int(pdf["__block"].iat[0]), pdf["__times"].to_numpy(np.float64)
        if block:
            marks = (pdf["__mark"].to_numpy(np.int64).view(np.uint64) + np.uint64(block * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)
            weights = drawn_weights(marks, times, min(REPLICATES, n_boot - (block - 1) * REPLICATES))
        else:
            weights = times[:, None]
        sizes = pdf["rows"].map(len).to_numpy()
        pairs = np.array([(r["__a"], r["__b"]) for rows in pdf["rows"] for r in rows])
        spread = np.repeat(weights, sizes, axis=0)
        found = []
        for arm in (0, 1):
            order = np.argsort(pairs[:, arm], kind="stable")
            found.append(statistic.of(pairs[order, arm], spread[order]))
        out = pd.DataFrame({"first": found[0], "second": found[1]})
        out["n_clusters"], out["n_paired"], out["block"] = int(times.sum()), int((times * sizes).sum()), block
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "block", "n_clusters", "n_paired", "first", "second"]]

    kinds = dict(df.dtypes)
    drawn_rows = d.groupBy(*keys, "__block").applyInPandas(draw, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "block int, n_clusters long, n_paired long, first double, second double"]))
    sample, gap = F.col("block") == 0, F.nanvl(F.col("second") - F.col("first"), F.lit(None).cast("double"))
    of = F.when(~sample, gap)
    n = F.count(of)
    p = F.least(F.lit(1.0), F.greatest(2 * F.least(F.try_divide(F.count_if(of <= 0), n), F.try_divide(F.count_if(of >= 0), n)), F.lit(1 / max(1, n_boot))))
    only = lambda c: F.max(F.when(sample, c))
    out = drawn_rows.groupBy(*keys).agg(
        only(F.col("n_clusters")).alias("n_clusters"), only(F.col("n_paired")).alias("n_paired"), only(F.col("first")).alias("first"), only(F.col("second")).alias("second"), only(gap).alias("delta"),
        _bounds(of, alpha).alias("__ci"), F.when(n > 0, p).alias("p_value"),
    )
    bound = lambda c: _alone(c, "n_clusters")
    return out.select(*keys, "n_clusters", "n_paired", "first", "second", "delta", bound(F.col("__ci")[0]).alias("delta_lo"), bound(F.col("__ci")[1]).alias("delta_hi"), bound(F.col("p_value")).alias("p_value"))


def _paired_quantiles(d: DataFrame, keys: list[str], q: float) -> DataFrame:
    """paired_value_bootstrap()'s rows of a quantile without draws. d: *keys, __cluster, __a, __b."""
    d = kept(d.select(*keys, "__cluster", "__a", "__b"), "pairs")
    out = d.groupBy(*keys, "__cluster").agg(F.count(F.lit(1)).alias("__rows")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("__rows").alias("n_paired"))
    for arm, name in (("__a", "first"), ("__b", "second")):
        out = with_few(out, quantiles(d, keys, arm, {name: q}), keys)
    delta, none = F.nanvl(F.col("second") - F.col("first"), F.lit(None).cast("double")), F.lit(None).cast("double")
    return out.select(*keys, "n_clusters", "n_paired", "first", "second", delta.alias("delta"), *[_alone(none, "n_clusters").alias(c) for c in ("delta_lo", "delta_hi", "p_value")])
