"""Substring dedup by FM-indexes of shards.

A window is `window` consecutive words. Its minimizer, the least hash of its GRAM-word grams, depends on its words only, so
equal windows have equal minimizers, wherever they are. Texts are cut into stretches: runs of windows of one minimizer.
Stretches whose minimizer is found once in all documents, and once in their own text, hold no repeated window. The others are dealt to shards by minimizer,
equal ones as one with a mark, and each shard builds a compressed FM-index of its stretches and streams all of them through
it: backward searches give matching statistics, and intervals of at least a window's length that occur elsewhere are reported.
So a shard needs no other shard's index, and work grows with the input, not with shards times documents.

A minimizer of very many different stretches would fill a shard; its stretches are dealt window by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, row_key, saved, skew_join
from .fm_index import FMIndex

GRAM = 8
#: Windows of a stretch at most.
STRETCH = 64
#: Different stretches of a minimizer from which on they are dealt window by window.
HOT_STRETCHES = 512
#: Words of a shard, about.
SHARD_WORDS = 300_000
_U = np.uint64


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+."""
    words = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def minimizers(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of each window of word hashes, and the sorted grams that the text has more than once."""
    n = len(h) - window + 1
    if n < 1:
        return (np.zeros(0, np.uint64),) * 2
    gram = min(GRAM, window)
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g = g * _U(0x9E3779B97F4A7C15) + h[k : len(h) - gram + 1 + k]
    least, span, want = _mix(g), 1, window - gram + 1
    ordered = np.sort(least)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    while span * 2 <= want:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    return np.minimum(least[:n], least[want - span : want - span + n]), again


def stretches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal minimizers, cut at STRETCH windows, and their lengths in windows."""
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    run = np.diff(np.append(edge, len(m)))
    pieces = -(-run // STRETCH)
    starts = np.repeat(edge, pieces) + STRETCH * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return starts, np.diff(np.append(starts, len(m)))


def _digest(part: np.ndarray) -> bytes:
    return hashlib.blake2b(part.tobytes(), digest_size=16).digest()


def _cut(window: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row, text in zip(batch["row"], batch["text"], strict=True):
                h = word_hashes(text)
                m, again = minimizers(h, window)
                starts, sizes = stretches(m)
                own = m[starts]
                times = 1 + (again[np.searchsorted(again, own) % len(again)] == own) if len(again) else np.ones(len(own), np.int64)
                out += [(x, t, _digest(h[s : s + n + window - 1]), row, s, n) for x, t, s, n in zip(own.view(np.int64).tolist(), times.tolist(), starts.tolist(), sizes.tolist(), strict=True)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["m", "times", "stretch", "row", "start", "n"])
                    out = []
            yield pd.DataFrame(out, columns=["m", "times", "stretch", "row", "start", "n"])

    return cut


def _contents(window: int):
    """Word hashes of the stretches that a row stands for; of a hot minimizer's stretch, of each of its windows."""

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "stretch", "at", "piece", "weight", "hashes"]
        for batch in batches:
            out: list[tuple] = []
            for text, parts in zip(batch["text"], batch["parts"], strict=True):
                h = word_hashes(text)
                for p in parts:
                    s, n = p["start"], p["n"]
                    if not p["hot"]:
                        out.append((p["m"], p["stretch"], None, p["stretch"], p["weight"], h[s : s + n + window - 1].tobytes()))
                        continue
                    for w in range(n):
                        piece = h[s + w : s + w + window]
                        name = _digest(piece)
                        out.append((int.from_bytes(name[:8], "little", signed=True), p["stretch"], w, name, p["weight"], piece.tobytes()))
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=names).astype({"at": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=names).astype({"at": "Int64"})

    return contents


def _index_shard(window: int):
    def index(group: pd.DataFrame) -> pd.DataFrame:
        pieces = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
        fm = FMIndex(pieces, group["weight"].to_numpy(np.int64) > 1, STRETCH + window)
        which, start, end = fm.repeats(pieces, window)
        names = group["piece"].to_numpy()
        order = np.argsort(which, kind="stable")
        cuts = np.flatnonzero(np.diff(which[order])) + 1 if len(order) else np.zeros(0, np.int64)
        out = [(names[which[p[0]]], np.stack([start[p], end[p]], 1).ravel().tolist()) for p in np.split(order, cuts) if len(p)]
        return pd.DataFrame(out, columns=["piece", "spans"])

    return index


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for i, text, spans in zip(batch["id"], batch["text"], batch["spans"], strict=True):
            words = (text or "").encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for p in spans if spans is not None else ():
                cover = np.asarray(p["spans"], np.int64).reshape(-1, 2) + p["start"]
                np.add.at(edge, cover[:, 0], 1)
                np.add.at(edge, cover[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
            out.append((i, len(words), len(words) - len(kept), b" ".join(kept)))
        yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"]).astype({"id": "Int64"})


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row of docs: every word that a window covers whose words also start anywhere else
    is removed, and kept has the others, joined by one space, as UTF-8 bytes.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; null, empty and blank texts have none. Every row is a document, so repeated rows
    repeat each other's windows. Ids may be null, other columns are ignored, and an empty table gives an empty result.
    Words are compared by 64-bit hashes: another window is taken for equal only if all its words' hashes agree. A minimizer of more
    than hot_stretches different stretches is dealt window by window; results don't depend on it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = saved(d.select("row", "text").mapInPandas(_cut(window), "m long, times int, stretch binary, row binary, start int, n int"), "sub-stretches")
    twice = cut.groupBy("m").agg(F.sum("times").alias("c")).where("c > 1").select("m")
    repeated = saved(skew_join(cut, twice, ["m"], "left_semi", "sub"), "sub-repeated")
    kinds = saved(repeated.groupBy("m", "stretch", "n").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("row", "start")).alias("of")), "sub-kinds")
    hot = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_stretches).select("m", F.lit(True).alias("hot"))
    kinds = skew_join(kinds, saved(hot, "sub-hot"), ["m"], "left", "sub-kinds")
    part = F.struct("m", "stretch", F.col("of.start").alias("start"), "n", "weight", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = kinds.groupBy(F.col("of.row").alias("row")).agg(F.collect_list(part).alias("parts"))
    found = d.select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("text", "parts")
    pieces = saved(found.mapInPandas(_contents(window), "key long, stretch binary, at int, piece binary, weight long, hashes binary"), "sub-pieces")
    entries = pieces.where("at IS NOT NULL").groupBy("key", "piece").agg(F.sum("weight").alias("weight"), F.first("hashes").alias("hashes"))
    entries = pieces.where("at IS NULL").select("key", "piece", "weight", "hashes").unionByName(entries)
    words = pieces.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    shards = max(parts, words // 8 // SHARD_WORDS + 1)
    entries = entries.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    spans = saved(entries.groupBy("shard").applyInPandas(_index_shard(window), "piece binary, spans array<int>"), "sub-spans")
    # Spans of whole stretches are theirs; those of windows go back to the stretches that hold them.
    windows = skew_join(pieces.where("at IS NOT NULL").select("piece", "stretch", "at"), spans, ["piece"], "inner", "sub-windows")
    shifted = windows.select("stretch", F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
    of_hot = shifted.groupBy("stretch").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = spans.join(pieces.where("at IS NULL").select("piece"), "piece", "left_semi").select(F.col("piece").alias("stretch"), "spans")
    by_stretch = saved(whole.unionByName(of_hot), "sub-by-stretch")
    covers = skew_join(repeated.select("stretch", "row", "start"), by_stretch, ["stretch"], "inner", "sub-covers")
    covers = covers.groupBy("row").agg(F.collect_set(F.struct("start", "spans")).alias("spans"))
    marked = d.join(covers, "row", "left").select("id", "text", "spans")
    return marked.mapInPandas(_remove, "id long, n_words long, n_removed long, kept binary")
