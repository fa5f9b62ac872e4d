"""Importance resampling towards a target distribution, on hashed n-grams.

Words get integer ids in a dictionary, n-grams are tuples of ids, and the bytes of each distinct tuple are hashed once; the hashes'
buckets are joined back to all uses of the tuple. Bucket counts of the raw and of the target texts give each bucket a gain, a
text's weight is the sum of its features' gains, and Gumbel noise on the weights makes the highest scores a draw without replacement.

A dictionary belongs to a task and tuples to a block of texts (an Arrow batch): most tuples of three words are rare, so to number and to join
them over the whole corpus would shuffle several times its size, twice, while a text's features need nothing of other texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, numbered, saved

#: Buckets of the hashed features, words of the longest n-gram, and words from which on a text may be drawn.
BUCKETS, LONGEST, MIN_WORDS = 10_000, 3, 20
#: Bytes of words, about, that a task's dictionary holds; it is emptied between blocks beyond that.
DICTIONARY_BYTES = 32 << 20

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: digits, letters and every byte of other characters; the rest parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

BAG = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_features", T.LongType(), False), T.StructField("bag", T.BinaryType(), False)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class WordIds(dict):
    """word -> id, given in order of appearance, with each id's bytes after a space and the CRC-32 of its own bytes."""

    ENTRY = 250

    def __init__(self):
        super().__init__()
        self.spaced: list[bytes] = []
        self.crcs: list[int] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = own = len(self.spaced)
        self.spaced.append(b" " + word)
        self.crcs.append(zlib.crc32(word))
        self.size += self.ENTRY + 2 * len(word)
        return own


def block_bags(texts: Sequence[str | None], ids: WordIds, buckets: int = BUCKETS, longest: int = LONGEST) -> list[tuple[int, int, bytes]]:
    """(n_words, n_features, bag) of each text; a bag is the sorted buckets of all features as differences, unsigned 16-bit."""
    lists = [words_of(x) for x in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    code = np.fromiter((ids[w] for ws in lists for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(lists)), sizes)
    last, n_ids = code, len(ids)
    index, docs, found = code, doc, []
    spaced, crcs = ids.spaced, np.array(ids.crcs, np.int64)
    for size in range(1, longest + 1):
        if size > 1:
            # A tuple of `size` ids is the number of its beginning, a distinct tuple, and its last id; both lie in one text.
            last, inside = last[1:], docs[:-1] == docs[1:] if size == 2 else docs[:-1] == doc[size - 1 :]
            pair = index[:-1] * max(n_ids, 1) + last
            distinct, back = np.unique(pair[inside], return_inverse=True)
            first, word = np.divmod(distinct, max(n_ids, 1))
            crcs = np.fromiter(map(zlib.crc32, map(spaced.__getitem__, word.tolist()), crcs[first].tolist()), np.int64, len(distinct))
            index = np.zeros(len(pair), np.int64)
            index[inside] = back
            # Places whose tuple crosses a text's end are given a text that no place has.
            docs = np.where(inside, docs[:-1], -1)
        use = docs >= 0
        found.append((docs[use], (crcs % buckets)[index[use]]))
    owner, bucket = np.concatenate([d for d, _ in found]), np.concatenate([b for _, b in found])
    both = np.sort(owner * buckets + bucket)
    owner, bucket = np.divmod(both, buckets)
    edges = np.searchsorted(owner, np.arange(len(lists) + 1))
    steps = np.diff(bucket, prepend=0)
    heads = edges[:-1][edges[:-1] < edges[1:]]
    steps[heads] = bucket[heads]
    steps = steps.astype("<u2")
    return [(int(n), int(b - a), steps[a:b].tobytes()) for n, a, b in zip(sizes, edges[:-1], edges[1:], strict=True)]


def bag_buckets(bag: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(bag, "<u2"), dtype=np.int64)


def bagger(buckets: int, longest: int) -> Callable[[Column], Column]:
    """text -> struct<n_words, n_features, bag>; null is the empty text."""

    @F.pandas_udf(BAG)
    def bags(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for batch in texts:
            if ids.size > DICTIONARY_BYTES:
                ids = WordIds()
            yield pd.DataFrame(block_bags(batch.tolist(), ids, buckets, longest), columns=BAG.names)

    return bags


def bucket_counts(bags: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all bags. A task sends a row for each bucket that it met, and the driver gets `buckets` numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bag in batch["bag"]:
                total += np.bincount(bag_buckets(bag), minlength=buckets)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": met, "n": total[met]})

    rows = bags.select("bag").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log-likelihood ratio of target to raw, with one feature more in every bucket, in floored thousandths."""
    s, t, n = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def importance(docs: DataFrame, target: DataFrame, *, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST, keep: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(original struct<keep, by default all input columns>, id, n_words, n_features, weight, score) of every row of docs; target has texts in text_col too.

    Whole texts count, repeated rows as often as they are there. Null and empty texts have no features and weight 0.
    The noise of a row hangs on its id and the seed, so rows of one id share it; a null id is the empty string there.
    Other columns, whatever their names, stay inside `original`. An empty table gives an empty result; without target texts the gains
    are those of no target features.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be from 1 to 65536")
    spark = docs.sparkSession
    bounded_batches(spark)
    bag = bagger(buckets, longest)
    keep = docs.columns if keep is None else list(keep)
    at = lambda names: F.struct(*[F.col(f"`{c}`") for c in names])
    d = docs.select(at(keep).alias("original"), F.col(id_col).alias("id"), bag(F.col(text_col)).alias("own"))
    d = saved(d.select("original", "id", "own.*"), "importance-bags")
    gain = gains(bucket_counts(d, buckets), bucket_counts(target.select(bag(F.col(text_col)).alias("own")).select("own.bag"), buckets))

    @F.pandas_udf(T.LongType())
    def weigh(bags: pd.Series) -> pd.Series:
        return pd.Series([int(gain[bag_buckets(b)].sum()) for b in bags], dtype="int64")

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return d.withColumn("weight", weigh("bag")).select("original", "id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def draw(scored: DataFrame, percent: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """importance()'s rows with rank: of the N rows with at least min_words words the floor(percent * N / 100) of highest score have 1, 2, 3 ..., ties to the
    smaller id (null first); the others have null. Places come from a distributed sort of narrow rows."""
    scored = saved(scored, "importance-scored")
    may = F.col("n_words") >= min_words
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("n_features"), F.monotonically_increasing_id()]
    places = numbered(scored.where(may), order, "importance-places")
    most = percent * scored.where(may).count() // 100
    drawn = places.withColumn("rank", F.when(F.col("at") < most, F.col("at") + 1)).drop("at")
    return drawn.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """The rows of docs that are drawn, with the columns of docs."""
    return draw(importance(docs, target, **options), percent, min_words).where("rank IS NOT NULL").select("original.*")
