"""Token-id files with keyed access.

A shard file holds the raw ids of its documents, their keys in order, and a minimal perfect hash of the keys: levels of
bit arrays in which every key owns a bit, so that the number of bits set before it is its slot. A slot stores a fingerprint
of its key and the document's number, which gives the place of its ids. Layout, all little-endian:

    b"TARNTOK1", header of 6 uint64 (docs, ids, bytes of an id, levels, partition, ids of the partition before this shard),
    level sizes uint64[levels] (in 64-bit words), level words uint64, ranks before each word uint32,
    fingerprints uint32[docs], slot -> document uint32[docs], id offsets uint64[docs + 1], keys int64[docs],
    key flags uint8[docs] (1: the key is null), copies uint32[docs] (which of the rows of an equal key), ids

Documents ascend by key, null keys first; shards of a partition and partitions ascend too. A shard's folder is named
shard=<partition>_<ids of the partition before it>_<its ids>_<first key>_<last key>, so that a listing of the folders is the index
from keys to shards and gives all starts, and no file is opened for either.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import Remembered, bounded_batches, work_path, write_blobs

MAGIC, TRAILER = b"TARNTOK1", b"TARNEND1"
#: A shard is closed when it has so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 21, 1 << 16
LEVEL_LOAD, MAX_LEVELS = 2, 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: a permutation of the 64-bit integers for each seed."""
    z = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def key_codes(keys: np.ndarray, nulls: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """One 64-bit code for each (key or null, which copy); copies of a key have codes of their own."""
    base = mix64(keys.astype(np.int64).view(np.uint64), 101)
    base = np.where(nulls.astype(bool), mix64(np.zeros(1, np.uint64), 103)[0], base)
    return np.where(copies > 0, mix64(base ^ mix64(copies.astype(np.uint64), 107), 109), base)


class PerfectHash:
    """Minimal perfect hash of distinct codes, by levels of bit arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.words, self.before = words, (np.cumsum(counts) - counts).astype(np.uint32)
        self.starts = np.cumsum([0, *(len(x) for x in levels)])

    @classmethod
    def build(cls, codes: np.ndarray) -> PerfectHash:
        levels, left = [], codes
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("two keys have the same code")
            n = max(1, -(-len(left) * LEVEL_LOAD // 64))
            at = (mix64(left, len(levels)) % np.uint64(n * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=n * 64)[at] == 1
            bits = np.zeros(n * 64, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone]
        return cls(levels)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """Each code's slot; -1 for codes that own no bit (a code that was not built in may find some slot)."""
        out = np.full(len(codes), -1, np.int64)
        open_ = np.arange(len(codes))
        for i, level in enumerate(self.levels):
            at = (mix64(codes[open_], i) % np.uint64(len(level) * 64)).astype(np.int64)
            word, bit = self.starts[i] + at // 64, (at % 64).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out


def fingerprints(codes: np.ndarray) -> np.ndarray:
    return (mix64(codes, 211) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: list[int | None], copies: list[int], ids: list[bytes], width: int, partition: int, before: int) -> bytes:
    """The bytes of a shard; ids: each document's, of width bytes an id."""
    nulls = np.array([k is None for k in keys], np.uint8)
    numbers = np.array([0 if k is None else k for k in keys], np.int64)
    copy = np.array(copies, np.uint32)
    codes = key_codes(numbers, nulls, copy)
    mph = PerfectHash.build(codes)
    slot_prints, slot_docs = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    slots = mph.slots(codes)
    slot_prints[slots], slot_docs[slots] = fingerprints(codes), np.arange(len(keys))
    offsets = np.cumsum([0, *(len(x) // width for x in ids)]).astype("<u8")
    parts = [MAGIC, struct.pack("<6Q", len(keys), int(offsets[-1]), width, len(mph.levels), partition, before)]
    parts += [x.tobytes() for x in (np.array([len(x) for x in mph.levels], "<u8"), mph.words.astype("<u8"), mph.before.astype("<u4"), slot_prints, slot_docs, offsets, numbers.astype("<i8"), nulls, copy.astype("<u4"))]
    return b"".join([*parts, *ids])


class Shard:
    """A shard read back; get() takes constant time."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC or content[-len(TRAILER) :] != TRAILER:
            raise ValueError("not a token shard")
        self.docs, self.ids, self.width, levels, self.partition, self.before = struct.unpack_from("<6Q", content, 8)
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        sizes = take("<u8", levels).astype(np.int64)
        words = take("<u8", int(sizes.sum())).astype(np.uint64)
        take("<u4", len(words))
        self.hash = PerfectHash(np.split(words, np.cumsum(sizes)[:-1]) if levels else [])
        self.prints, self.slot_docs = take("<u4", self.docs), take("<u4", self.docs)
        self.offsets, self.keys = take("<u8", self.docs + 1).astype(np.int64), take("<i8", self.docs)
        self.nulls, self.copies = take("u1", self.docs), take("<u4", self.docs)
        self.payload = np.frombuffer(content, f"<u{self.width}", self.ids, at)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Document numbers of codes; -1 for keys that the shard does not hold (a wrong one passes with odds of 2^-32)."""
        slots = self.hash.slots(codes)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(codes[known])
        out = np.full(len(codes), -1, np.int64)
        out[known] = self.slot_docs[slots[known]]
        return out

    def every(self, keys: list[int | None]) -> np.ndarray:
        """Document numbers of all rows of the keys that the shard holds. A key's rows follow each other, so one that is found leads to
        the others; which copy the shard begins with is known from its first row."""
        out = []
        for key in keys:
            first = int(self.copies[0]) if self.docs and (self.nulls[0] == 1, self.keys[0]) == (key is None, key or 0) else 0
            at = int(self.find(key_codes(np.array([key or 0]), np.array([key is None]), np.array([first])))[0])
            while 0 <= at < self.docs and (self.nulls[at] == 1, self.keys[at]) == (key is None, key or 0):
                out.append(at)
                at += 1
        return np.array(out, np.int64)

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        code = key_codes(np.array([key or 0]), np.array([key is None]), np.array([copy]))
        doc = int(self.find(code)[0])
        return None if doc < 0 else self.payload[self.offsets[doc] : self.offsets[doc + 1]]


class _Packers(dict):
    """struct packers by number of ids."""

    def __init__(self, letter: str):
        super().__init__()
        self.letter = letter

    def __missing__(self, n: int) -> struct.Struct:
        self[n] = found = struct.Struct(f"<{n}{self.letter}")
        return found


# Normaliser and pre-tokenizer settings under which words between blanks are encoded one by one.
BY_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BY_WORD_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_blanks(settings: dict) -> bool:
    """Whether the tokenizer's own settings let words between blanks be encoded one by one: every match of its pattern lies between
    two blanks, its normaliser changes nothing across a blank (NFC never composes one, case is mapped character by character),
    no added token has or strips a blank, and merges are not random."""
    added = all(not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in settings["added_tokens"])
    model = settings["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and settings.get("truncation") is None and settings.get("padding") is None
    return added and plain and settings["normalizer"] == BY_WORD_NORMALIZER and settings["pre_tokenizer"] == BY_WORD_PRE_TOKENIZER


class WordEncoder:
    """The tokenizer's ids of whole texts: word by word ([^\\x20\\x09-\\x0D]+) where splits_at_blanks() allows it. There a word of Latin-1 letters
    followed by ASCII marks other than the apostrophe is two pre-tokens, the letters lower-cased and the marks."""

    #: Bytes of words, of runs of letters and of runs of marks that a worker remembers.
    WORDS, RUNS, MARKS = 104 << 20, 40 << 20, 2 << 20
    _WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str, width: int, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.packers = _Packers("H" if width == 2 else "I")
        self.known, self.runs, self.marks = Remembered(self._word, self.WORDS), Remembered(self._run, self.RUNS), Remembered(self._whole, self.MARKS)
        self.tokenize = self.tokenizer.model.tokenize
        self.end = b"" if end_id is None else self._pack([end_id])
        chars = byte_characters()
        self.bytewise = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.by_word = splits_at_blanks(json.loads(self.tokenizer.to_str()))

    def _pack(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)].pack(*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}{self.packers.letter}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        """A run of letters, lower-cased."""
        return self._pack([t.id for t in self.tokenize(run if run.isascii() else run.translate(self.bytewise))])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        found = self._WORD.match(text)
        if not found:
            return self._whole(text)
        run, marks = found.groups()
        return self.runs[run.lower()] + self.marks[marks] if marks else self.runs[run.lower()]

    def encode(self, text: bytes) -> bytes:
        return (b"".join(map(self.known.__getitem__, text.split())) if self.by_word else self._whole(text.decode())) + self.end


@lru_cache(maxsize=1)
def _encoder(path: str, width: int, end_id: int | None) -> WordEncoder:
    return WordEncoder(path, width, end_id)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, *, width: int = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes whole texts' ids as shards below path, documents in ascending id order, null ids first.

    Texts are dealt by ranges of ids and, within an id, of hashes of their texts, so an id of many rows is split; one shuffle, and
    encoding after it. width: bytes of an id. Null and empty texts have the end id only. Rows of one id follow each
    other, and are told apart by partition and copy, a number; other columns are not kept. An empty table writes no shard.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.asc_nulls_first("id"), F.asc("hash")]
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("id", F.col("text").cast("binary").alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, partition = _encoder(tokenizer_path, width, end_id), TaskContext.get().partitionId()
        keys, copies, ids, held, before, last = [], [], [], 0, 0, (0, None)

        def shard() -> pd.DataFrame:
            name = "_".join("null" if x is None else str(x) for x in (partition, before, held, keys[0], keys[-1]))
            return pd.DataFrame({"blob": [pack_shard(keys, copies, ids, width, partition, before)], "shard": [name]})

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"], strict=True):
                key, own = None if pd.isna(key) else int(key), codec.encode(bytes(text))
                last = (last[0] + 1, key) if last[1] == key and (keys or before or held) else (0, key)
                keys.append(key)
                copies.append(last[0])
                ids.append(own)
                held += len(own) // width
                if held >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                    yield shard()
                    before, held = before + held, 0
                    keys, copies, ids = [], [], []
        if keys:
            yield shard()

    write_blobs(d.mapInPandas(pack, "blob binary, shard string"), "blob", path, TRAILER, "shard")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a shard below path: path, partition, before, n_ids, first_key, last_key, from the folders' names alone."""
    found = spark.read.format("binaryFile").load(path)
    if "shard" not in found.columns:  # no shard was written
        found = found.withColumn("shard", F.lit(None).cast("string"))
    part = F.split("shard", "_")
    number = lambda i: F.nullif(part[i], F.lit("null")).cast("long")
    return found.select("path", *[number(i).alias(c) for i, c in enumerate(("partition", "before", "n_ids", "first_key", "last_key"))])


def _documents(spark: SparkSession, path: str, covers: Column | None, wanted: list[int | None] | None) -> DataFrame:
    """Documents of the shards that covers() names; of all keys, or of wanted ones."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                s = Shard(bytes(content))
                found = s.find(key_codes(s.keys, s.nulls, s.copies)) if wanted is None else s.every(wanted)
                start, end = s.offsets[found], s.offsets[found + 1]
                for at in range(0, len(found), 1000):
                    part = slice(at, at + 1000)
                    docs = found[part]
                    yield pd.DataFrame({
                        "doc_id": pd.arrays.IntegerArray(s.keys[docs].astype(np.int64), s.nulls[docs] == 1),
                        "copy": s.copies[docs].astype(np.int64), "partition": np.int64(s.partition), "offset": s.before + start[part],
                        "n_tokens": end[part] - start[part], "ids": [s.payload[a:b].astype("<u4").tobytes() for a, b in zip(start[part], end[part], strict=True)],
                    })

    blobs = spark.read.format("binaryFile").load(path)
    if covers is not None and "shard" in blobs.columns:
        blobs = blobs.where(covers)
    return blobs.select("content").mapInPandas(documents, "doc_id long, copy long, partition long, offset long, n_tokens long, ids binary")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards below path: doc_id, copy, partition, offset (ids of its partition before it), n_tokens and
    ids (as little-endian unsigned 32-bit integers), each found by its key through the shard's hash."""
    return _documents(spark, path, None, None)


def read_keys(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """read_token_files' rows of a few keys (None: null). Only shards whose first and last key enclose one of them are opened, and each
    key takes constant time there; keys that no shard holds give no row."""
    part = F.split("shard", "_")
    low, high = F.nullif(part[3], F.lit("null")).cast("long"), F.nullif(part[4], F.lit("null")).cast("long")
    covers = F.lit(False)
    for key in set(keys):
        covers = covers | (low.isNull() if key is None else (low.isNull() | (low <= key)) & high.isNotNull() & (high >= key))
    return _documents(spark, path, covers, list(dict.fromkeys(keys)))


def with_starts(tokens: DataFrame, shards: DataFrame) -> DataFrame:
    """read_token_files' rows with start: all ids before the document, by the manifest's sizes of partitions, one row each."""
    sizes = shards.groupBy("partition").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("partition", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(base), "partition").withColumn("start", F.col("base") + F.col("offset"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None, *, width: int = 2, **names) -> DataFrame:
    """Writes token files into the shared folder and reads them back, with starts."""
    spark = docs.sparkSession
    path = work_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, width=width, **names)
    return with_starts(read_token_files(spark, path), manifest(spark, path))
