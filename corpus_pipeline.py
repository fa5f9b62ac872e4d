"""A training-data pipeline of five operators: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.byte_bpe import round_trip_documents
from tarnspark.llm.common import saved, table
from tarnspark.llm.line_dedup import dedup_lines
from tarnspark.llm.mixing import mixed_documents
from tarnspark.llm.near_dedup import without_near_duplicates
from tarnspark.llm.quality import judge_documents

#: No source is used more often than this; the one with the most tokens is used once.
MAX_REPEAT = 2.0


def _with_text(judged: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The original rows with another text, and n_chars of it."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return judged.select(*[new[c].alias(c) if c in new else F.col(f"original.`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that pass."""
    judged = judge_documents(docs).where("verdict.kept")
    return _with_text(judged, docs.columns, F.col("verdict.clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays."""
    return _with_text(dedup_lines(docs), docs.columns, F.col("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8)."""
    return without_near_duplicates(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of smaller sources are repeated, up to MAX_REPEAT times on average; none is left out."""
    return mixed_documents(docs, max_repeat=MAX_REPEAT, seed=17)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each use of a document, and digests of them and of what they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = round_trip_documents(docs, ranks, pattern)
    return out.select("original.doc_id", "original.lang", "original.source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("byte bpe", byte_bpe)]

#: SQL can't express the bisection of the mix and the encoding; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
