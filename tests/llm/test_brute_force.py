"""Queries that SQL cannot express, against plain versions over the whole tables."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pytest

import corpus_pipeline
from tarnspark.llm import queries

from . import brute


@pytest.fixture(scope="module")
def documents(sf_dir):
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    return [(int(i), s, t) for i, s, t in zip(d["doc_id"], d["source"], d["text"], strict=True)]


def test_source_mix(spark, sf_dir, documents):
    got = queries.op1_source_mix(spark, sf_dir).select("doc_id", "source", "n_tokens", "epoch", "block", "place")
    assert sorted(map(tuple, got.collect())) == sorted(brute.mix(documents, 4.0, 17))


def test_byte_bpe(spark, sf_dir, documents):
    encoding = brute.codec()
    got = {tuple(r) for r in queries.op3_byte_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(i, *brute.bpe_row(encoding, t)) for i, _, t in documents}


def test_token_files(spark, sf_dir, documents):
    ordered, want, start = sorted((i, t) for i, _, t in documents), set(), 0
    for (i, _), ids in zip(ordered, brute.word_ids([t for _, t in ordered]), strict=True):
        ids = [*ids, 2]
        want.add((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = queries.op8_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert {tuple(r) for r in got.collect()} == want


def test_pipeline(spark, sf_dir, documents):
    docs = [(i, s, c) for i, s, t in documents if (c := brute.quality(t)) is not None]
    docs = [(i, s, t) for (i, s, _), t in zip(docs, brute.without_frequent_lines([t for *_, t in docs]), strict=True)]
    ids, sizes = brute.near_components([(i, t) for i, _, t in docs], 5, 80)
    docs = [d for d, own, n in zip(docs, ids, sizes, strict=True) if d[0] == own or not n]
    text, encoding = {i: t for i, _, t in docs}, brute.codec()
    want = sorted((i, *brute.bpe_row(encoding, text[i])) for i, *_ in brute.mix(docs, corpus_pipeline.MAX_REPEAT, 17))
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == want
