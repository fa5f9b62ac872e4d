"""Byte-level BPE through a sentencepiece model that is serialised directly from a vocabulary of byte ranks.

Every token's bytes are mapped to 256 printable characters, one a byte; a piece's score is its negative rank, and the
model normalises nothing. sentencepiece then merges the pair of best score first, the leftmost of equal ones, which is the
order of ranks. Pre-tokens are encoded one by one; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, bounded_batches

#: Bytes of words and their ids that a worker remembers.
REMEMBERED = 56 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines `base64(token) rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i has rank i; ranks without a token get a piece that no text holds, and the
    unknown piece, which a byte-level text never needs, comes last. Ranks must be exact as 32-bit floats."""
    top = max(ranks.values(), default=-1) + 1
    if top > 1 << 24:
        raise ValueError("ranks over 2^24 have no exact score")
    chars, tokens = byte_characters(), {r: t for t, r in ranks.items()}
    out = bytearray()
    for rank in range(top):
        token = tokens.get(rank)
        piece = "".join(chars[b] for b in token) if token is not None else f"{rank}"
        kind = 1 if token is not None else 5  # normal, unused
        out += _field(1, _field(1, piece.encode()) + _field(2, -float(rank)) + _field(3, kind))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # TrainerSpec: model_type BPE, unk_id; no begin, end or padding piece (-1 as a 64-bit varint).
    none = (1 << 64) - 1
    out += _field(2, _field(3, 2) + _field(4, top + 1) + _field(40, top) + _field(41, none) + _field(42, none) + _field(43, none))
    # NormalizerSpec: identity; no dummy prefix, no removal and no escape of white space.
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteBPE:
    """Encodes and decodes with ranks; ids are the ranks, as bytes of little-endian unsigned 32-bit integers."""

    #: A space between characters that are no white space: the pattern's matches never cross the place before it.
    _SAFE = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        # White space by Unicode's property, spelled out, as the libraries differ in the separators U+001C to U+001F.
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        spelled = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.pattern = regex.compile(spelled)
        self.chars = byte_characters()
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.later = Remembered(lambda x: self._piece(" " + x), REMEMBERED)  # ids of words that follow a space

    def _pre_token(self, word: str) -> bytes:
        raw = word.encode()
        if raw in self.ranks:
            return struct.pack("<I", self.ranks[raw])
        ids = self.model.encode("".join(self.chars[b] for b in raw))
        return np.asarray(ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join([self._pre_token(x) for x in self.pattern.findall(piece)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        level = text.replace("\n", " ")
        if " ".join(level.split()) != level:  # not only single spaces and line ends between words
            return b"".join([self._piece(x) if x[0] != " " else self.later[x[1:]] for x in self._SAFE.split(text)])
        head, *rest = text.split(" ")
        return self._piece(head) + b"".join(map(self.later.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def _by_batch(ranks_path: str, pattern: str, kind: T.DataType, convert: Callable) -> Callable[[Column], Column]:
    """A pandas UDF of convert(codec, values). Each worker loads the vocabulary once, and remembers words from task to task, as a task that
    begins with none spends most of its time on them; their bytes are bounded."""

    @F.pandas_udf(kind)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(ranks_path, pattern)
        for batch in values:
            yield convert(codec, batch)

    return run


def encoder(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """text -> ids as bytes; null is the empty text."""
    return _by_batch(ranks_path, pattern, T.BinaryType(), lambda codec, batch: pd.Series([codec.encode(x or "") for x in batch]))


def decoder(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """ids as bytes -> the text's bytes; null has none."""
    return _by_batch(ranks_path, pattern, T.BinaryType(), lambda codec, batch: pd.Series([codec.decode(bytes(x or b"")) for x in batch]))


def round_tripper(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """text -> struct<ids, decoded>: encoder() and decoder() in one worker."""

    def both(codec: ByteBPE, batch: pd.Series) -> pd.DataFrame:
        ids = [codec.encode(x or "") for x in batch]
        return pd.DataFrame({"ids": ids, "decoded": [codec.decode(x) for x in ids]})

    return _by_batch(ranks_path, pattern, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]), both)


def _with_count(out: DataFrame) -> DataFrame:
    return out.select("original", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *[c for c in out.columns if c != "original"])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(original struct<all input columns>, n_tokens, ids): ids are little-endian unsigned 32-bit integers.

    Whole texts are encoded, each match of pattern separately, without special tokens; null and empty texts give no ids.
    Rows are encoded one by one, so repeated rows, null ids and extra columns of any name are harmless. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    return _with_count(docs.select(F.struct("*").alias("original"), encoder(ranks_path, pattern)(F.col(text_col)).alias("ids")))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode_documents' rows with decoded, the bytes that the ids stand for."""
    return encoded.withColumn("decoded", decoder(ranks_path, pattern)(F.col("ids")))


def round_trip_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """decode_documents(encode_documents(docs)), with one Python worker a task instead of two."""
    bounded_batches(docs.sparkSession)
    out = docs.select(F.struct("*").alias("original"), round_tripper(ranks_path, pattern)(F.col(text_col)).alias("trip"))
    return _with_count(out.select("original", "trip.ids", "trip.decoded"))
