"""Exact top-k search by block-at-a-time pruning.

Vectors are ordered by the nearest of some centroids and how near it is, and cut into blocks of that order, so that a block's vectors are alike. A
block's summary has the greatest and least value of every dimension (term), so the sum of a query's best terms bounds every
score in the block. Each query visits blocks in order of that bound, a few more in each round, through the blocks' packed
forward indexes, until the next bound is below its k-th score.

The centroids only order the vectors: they are fitted on a bounded sample, and every vector is indexed and every bound is exact whatever they
are. How much is pruned depends on the vectors: those of tight groups are pruned, for independent random directions of
many dimensions no block's bound is below the k-th score, and every block is visited.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved

#: Vectors of a block, at most; block summaries of a row of work; queries of a row of work.
BLOCK_ROWS, SUMMARIES, QUERY_PACK = 1024, 256, 256
#: Vectors that the centroids are fitted on, centroids at most, one for each so many vectors of the sample, and steps of the fit.
SAMPLE, CENTROIDS, SAMPLE_SHARE, STEPS = 4096, 256, 16, 6
#: Steps of the cosine distance from the centroid by which its vectors are told apart.
BANDS = 4
#: Blocks that a query visits in the first rounds; the last round takes all that the bounds leave.
ROUNDS = (1, 6)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): floor(256 x) of every component as double. Vectors null or with null or non-finite components are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~odd)
    # Spark's floor holds a double over the largest long at it, which would be another number.
    whole = lambda x: F.when(F.abs(x) < 2.0**55, F.floor(x * 256)).otherwise(F.raise_error("a component of 2^55 or more has no 64-bit value").cast("long"))
    return d.select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.transform(v, whole).alias("v"))


def _largest(x: np.ndarray) -> float:
    """The greatest absolute value, without a copy of x."""
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where every sum is below 2^53, by Python's integers where one might not fit 64 bits. Raises where one does not."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = _largest(q) * _largest(x) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    out = q.astype(object) @ x.T.astype(object)
    if max(map(abs, out.flat)) >= 1 << 63:
        raise OverflowError("an inner product has no 64-bit value")
    return out.astype(np.int64)


def block_bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that a query scores in each block; held at the largest 64-bit value, which no score exceeds, so nothing is pruned wrongly."""
    parts = (np.maximum(q, 0), top), (np.minimum(q, 0), low)
    most = sum(_largest(a) * _largest(b) * q.shape[1] for a, b in parts)
    if most < 2.0**62:
        return sum(product(a, b) for a, b in parts)
    whole = sum(a.astype(object) @ b.T.astype(object) for a, b in parts)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrix(rows, dim: int) -> np.ndarray:
    return np.stack([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros((0, dim), np.int64)


def _held(columns, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, columns)), np.int64).reshape(-1, dim) if dim else np.zeros((len(columns), 0), np.int64)


def centroids(sample: np.ndarray) -> np.ndarray:
    """Spherical k-means of a few vectors; unit rows."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    c = x[:: max(1, len(x) // max(1, min(CENTROIDS, len(x) // SAMPLE_SHARE)))][:CENTROIDS]
    for _ in range(STEPS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, sums, c)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _ordered(d: DataFrame, parts: int) -> DataFrame:
    """(id, dim, v, cell), partitioned and sorted by dim, cell and id, so equal rows follow each other. The driver gets SAMPLE vectors, those
    whose ids have the least hashes."""
    sample = d.select("dim", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    fitted = {int(dim): centroids(_matrix(list(own["v"]), dim).astype(np.float64)) for dim, own in sample.groupby("dim") if dim}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int64)
            dims = batch["dim"].to_numpy()
            for dim, c in fitted.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    x = _matrix(list(batch["v"].iloc[at]), dim)
                    like = x @ c.T
                    far = 1 - like.max(1) / np.maximum(np.linalg.norm(x, axis=1), 1e-12)
                    cell[at] = like.argmax(1) * BANDS + np.minimum(far * BANDS, BANDS - 1).astype(np.int64)
            yield batch.assign(cell=cell)

    placed = d.mapInPandas(place, "id long, dim int, v array<long>, cell long")
    return placed.repartitionByRange(parts, "dim", "cell", "id").sortWithinPartitions("dim", "cell", "id", "v")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, key, last = [], None, None

    def out() -> pd.DataFrame:
        m = _matrix([v for _, v, _ in held], key[0])
        return pd.DataFrame({"dim": [key[0]], "n": [len(held)], "ids": [np.array([i for i, _, _ in held], np.int64).tobytes()], "firsts": [np.array([f for *_, f in held], np.uint8).tobytes()], "rows": [m.tobytes()], "top": [m.max(0).tobytes()], "low": [m.min(0).tobytes()]})

    for batch in batches:
        for i, dim, v, cell in zip(batch["id"], batch["dim"], batch["v"], batch["cell"], strict=True):
            if held and (key != (dim, cell) or len(held) >= BLOCK_ROWS):
                yield out()
                held = []
            own = (i, np.asarray(v, np.int64).tobytes())
            held.append((i, v, own != last))
            key, last = (dim, cell), own
    if held:
        yield out()


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dim, own in batch.groupby("dim"):
            for at in range(0, len(own), SUMMARIES):
                part = own.iloc[at : at + SUMMARIES]
                yield pd.DataFrame({"dim": [dim], "blocks": [part["block"].to_numpy(np.int64).tobytes()], "tops": [b"".join(map(bytes, part["top"]))], "lows": [b"".join(map(bytes, part["low"]))]})


def _query_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dim, own in batch.groupby("dim"):
            for at in range(0, len(own), QUERY_PACK):
                part = own.iloc[at : at + QUERY_PACK]
                yield pd.DataFrame({"dim": [dim], "numbers": [part["number"].to_numpy(np.int64).tobytes()], "vs": [_matrix(list(part["v"]), dim).tobytes()], "kths": [part["kth"].to_numpy(np.float64).tobytes()]})


def _chooser(most: int | None) -> Callable:
    """Blocks whose bound reaches a query's k-th score; of each row of work, the `most` best of them."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, numbers, vs, kths, blocks, tops, lows in batch[["dim", "numbers", "vs", "kths", "blocks", "tops", "lows"]].itertuples(index=False):
                numbers, blocks = np.frombuffer(numbers, np.int64), np.frombuffer(blocks, np.int64)
                q, top, low = (np.frombuffer(x, np.int64).reshape(-1, dim) if dim else np.zeros((n, 0), np.int64) for x, n in ((vs, len(numbers)), (tops, len(blocks)), (lows, len(blocks))))
                bounds = block_bounds(q, top, low)
                keep = bounds >= np.nan_to_num(np.frombuffer(kths), nan=-np.inf)[:, None]
                if most is not None and most < bounds.shape[1]:
                    best = np.zeros_like(keep)
                    np.put_along_axis(best, np.argpartition(-bounds, most - 1, axis=1)[:, :most], True, 1)
                    keep &= best
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"number": numbers[i], "block": blocks[j], "bound": bounds[i, j]})

    return choose


def _scorer(k: int) -> Callable:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, ids, firsts, raw, numbers, query_ids, vs in zip(*(batch[c] for c in ("dim", "ids", "firsts", "rows", "numbers", "query_ids", "vs")), strict=True):
                ids, firsts = np.frombuffer(ids, np.int64), np.frombuffer(firsts, np.uint8) == 1
                x = np.frombuffer(raw, np.int64).reshape(len(ids), dim)
                out, q = [], _matrix(list(vs), dim)
                for number, query, v, own in zip(numbers, query_ids, q, product(q, x), strict=True):
                    mine = np.flatnonzero((ids == query) & firsts)
                    keep = np.delete(np.arange(len(ids)), mine[(x[mine] == v).all(1)])
                    if len(keep) > k:  # everything that reaches the k-th score, then ties to smaller ids
                        keep = keep[own[keep] >= np.partition(own[keep], len(keep) - k)[len(keep) - k]]
                    keep = keep[np.lexsort((ids[keep], -own[keep]))][:k]
                    out.append(pd.DataFrame({"number": number, "vec_id": ids[keep], "score": own[keep]}))
                if out:
                    yield pd.concat(out)

    return score


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(top_k's rows, blocks visited by each query (number, block), all blocks (block, dim, n))."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = quantised(vectors, id_col, vector_col)
    blocks = _ordered(d, parts).mapInPandas(_blocks, "dim int, n int, ids binary, firsts binary, rows binary, top binary, low binary")
    blocks = saved(blocks.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    summaries = blocks.select("block", "dim", "top", "low").mapInPandas(_summaries, "dim int, blocks binary, tops binary, lows binary")
    # Every pack of queries meets every pack of summaries: summaries are dealt to as many lots as there are partitions, queries to each.
    summaries = saved(summaries.withColumn("lot", F.pmod(F.xxhash64("blocks"), F.lit(parts))), "topk-summaries")
    q = quantised(queries, id_col, vector_col).groupBy("id", "dim", "v").agg(F.count(F.lit(1)).alias("times"))
    q = saved(q.withColumn("number", F.monotonically_increasing_id()).withColumnRenamed("id", "query_id"), "topk-queries")
    packs = math.ceil(max(1, q.count()) / QUERY_PACK)
    results = visited = None
    for rank, take in ((sum(ROUNDS[:i]), n) for i, n in enumerate((*ROUNDS, None))):
        state = q.withColumn("kth", F.lit(None).cast("double"))
        if results is not None:
            kth = results.groupBy("number").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
            state = q.join(kth.select("number", F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).cast("double").alias("kth")), "number", "left")
        asked = state.select("number", "dim", "v", "kth").repartition(packs).mapInPandas(_query_packs, "dim int, numbers binary, vs binary, kths binary")
        asked = asked.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        chosen = asked.join(summaries, ["dim", "lot"]).mapInPandas(_chooser(None if take is None else rank + take), "number long, block long, bound long")
        if take is not None:
            nth = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("bound"), "block"))
            chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= rank + take)
        if visited is not None:
            chosen = chosen.join(visited, ["number", "block"], "left_anti")
        chosen = saved(chosen.select("number", "block"), "topk-visits")
        visited = chosen if visited is None else visited.unionByName(chosen)
        work = chosen.join(q.select("number", "query_id", "v"), "number")
        work = work.groupBy("block", F.pmod(F.xxhash64("number"), F.lit(packs)).alias("pack")).agg(*[F.collect_list(c).alias(a) for c, a in (("number", "numbers"), ("query_id", "query_ids"), ("v", "vs"))])
        scored = work.join(blocks.select("block", "dim", "ids", "firsts", "rows"), "block").select("dim", "ids", "firsts", "rows", "numbers", "query_ids", "vs").mapInPandas(_scorer(k), "number long, vec_id long, score long")
        every = scored if results is None else results.select("number", "vec_id", "score").unionByName(scored)
        nth = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
        results = saved(every.withColumn("rank", nth).where(F.col("rank") <= k), "topk-best")
    found = results.join(q.select("number", "query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("use")), "number")
    return found.select("query_id", "rank", "vec_id", "score"), visited, blocks.select("block", "dim", "n")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest inner products of quantised vectors with the other rows' (query_id, rank, vec_id, score), all if
    there are fewer; ties go to the smaller id.

    A query's own row is one of its id and vector; further rows of that id, equal ones too, are candidates, and each repeated query
    has its own results. Vectors of another length are no candidates; empty ones score 0. Rows with a null id, or a vector
    that is null or has null or non-finite components, take no part. Other columns are ignored. Empty tables give an empty result.
    Components of 2^55 or more, and scores that do not fit 64 bits, raise.
    """
    return search(vectors, queries, k, id_col, vector_col)[0]
