"""What was cut or wrapped at a limit is whole or refused: mixes of rare sources, wide integers in scores, long members and records, keyed reads."""

from __future__ import annotations

import gzip
import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnspark.llm import mixing, token_files, topk, warc


def test_rare_sources_are_kept_or_refused(spark):
    with pytest.raises(ValueError, match="give a smaller budget"):
        mixing.solve_mix({"a": 900, "b": 100}, target_entropy=1e-6)
    with pytest.raises(ValueError, match="give a smaller budget"):
        mixing.solve_mix({"a": 900, "b": 100}, target_entropy=1e-10)
    assert mixing.solve_mix({"a": 900, "b": 100}, target_entropy=1e-6, budget=500).budgets == {"a": 500, "b": 0}
    mix = mixing.solve_mix({"a": 10**9, "b": 1}, max_repeat=3.0)
    assert mix.budgets["b"] in (1, 2, 3) and mix.budgets["a"] >= 10**9
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i else "b") for i in range(40)], "doc_id long, text string, source string")
    uses = mixing.mix_sources(docs, target_entropy=0.5).collect()
    assert {r["id"] for r in uses} == set(range(40))
    share = sum(r["n_tokens"] for r in uses if r["source"] == "b") / sum(r["n_tokens"] for r in uses)
    assert abs(mixing.entropy({"b": share, "a": 1 - share}) - 0.5) < 0.05


def test_wide_scores(spark):
    big = 3e7
    rows = [(0, [big, big, big, big]), (1, [big, big, big, -big]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [-big, big, -big, big])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.where("vec_id = 2"), k=3).orderBy("rank").collect()]
    assert got == [(0, int(big) * 65536), (1, int(big) * 65536), (3, -int(big) * 65536)]
    with pytest.raises(Exception, match="no 64-bit value"):
        topk.top_k(vectors, vectors.where("vec_id = 0"), k=3).collect()
    with pytest.raises(Exception, match="no 64-bit value"):
        topk.top_k(vectors.withColumn("embedding", F.array(F.lit(1e300))), vectors.where("vec_id = 0"), k=3).collect()
    draw = np.random.default_rng(1)
    q, top = draw.integers(-(10**9), 10**9, (5, 6)), draw.integers(0, 10**9, (4, 6))
    low = top - draw.integers(0, 10**9, (4, 6))
    exact = [[sum(max(int(a) * int(t), int(a) * int(m)) for a, t, m in zip(x, t_, m_, strict=True)) for t_, m_ in zip(top, low, strict=True)] for x in q]
    assert topk.block_bounds(q, top, low).tolist() == [[min(v, 2**63 - 1) for v in r] for r in exact]
    wide = q * 10**9
    assert (topk.block_bounds(wide, top * 10**9, low * 10**9) == 2**63 - 1).any()


def test_long_vectors(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(40, 5000))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(np.int64)
    got = topk.top_k(vectors, vectors.where("vec_id = 7"), k=5).orderBy("rank").collect()
    scores = sorted(((-int(whole[7] @ whole[i]), i) for i in range(40) if i != 7))[:5]
    assert [(-r["score"], r["vec_id"]) for r in got] == scores


def _members(n, size=900):
    return [warc.record(i, f"u{i}", (f"<p>{i}</p>" * size).encode()[: size + i], hashlib.sha256((f"<p>{i}</p>" * size).encode()[: size + i]).hexdigest(), None) for i in range(n)]


def test_members_over_the_limit_are_read_whole(monkeypatch):
    """Six records in one gzip member: the same rows whether the member is held whole or read as a stream."""
    plain = [gzip.decompress(m) for m in _members(6)]
    variants = {
        "whole": gzip.compress(b"".join(plain)),
        "noise inside": gzip.compress(plain[0] + b"noise WARC/1.\n" + plain[1] + b"\nWARC/1.1 no head\r\n" + b"".join(plain[2:])),
        "a bad length": gzip.compress(plain[0] + plain[1].replace(b"Content-Length: 9", b"Content-Length: 8", 1) + b"".join(plain[2:])),
        "no record": gzip.compress(b"x" * 50_000),
    }
    variants["between members"] = _members(2)[0] + variants["noise inside"] + _members(3)[2]
    variants["cut short"] = variants["whole"][:-12] + _members(4)[3]
    broken = bytearray(variants["whole"])
    broken[len(broken) // 2] ^= 0xFF
    variants["damaged"] = bytes(broken) + _members(3)[1]
    view = lambda data: [(x["kind"], x["start"], x["end"], x.get("record_id"), x.get("payload")) for x in warc.salvage(data) if x["kind"] == "record"]
    spans = lambda data: sorted({(x["start"], x["end"]) for x in warc.salvage(data)})
    want = {k: (view(v), spans(v)) for k, v in variants.items()}
    assert len(want["whole"][0]) == 6 and len(want["noise inside"][0]) == 6 and len(want["a bad length"][0]) == 5
    monkeypatch.setattr(warc, "MAX_CONTENT", 2500)
    monkeypatch.setattr(warc, "_STEP", 700)
    for k, v in variants.items():
        assert view(v) == want[k][0], k
        assert spans(v) == want[k][1], k


def test_a_record_over_the_limit_is_a_gap(monkeypatch):
    monkeypatch.setattr(warc, "MAX_CONTENT", 3000)
    big = warc.record(9, "u", b"y" * 8000, hashlib.sha256(b"y" * 8000).hexdigest(), None)
    small = [gzip.decompress(m) for m in _members(2)]
    found = list(warc.salvage(gzip.compress(small[0] + gzip.decompress(big) + small[1])))
    assert [x["kind"] for x in found] == ["record", "gap", "record"] and "over the limit" in found[1]["reason"]


def test_long_payload(spark):
    text = "é" * 3_000_000
    pages = spark.createDataFrame([(1, "u", text), (2, "u", text)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert got[2]["refers_to"] == 1 and got[1]["payload_bytes"] == 6_000_000 and got[1]["payload_digest"] == hashlib.sha256(text.encode()).hexdigest()


def test_keyed_reads(spark, tmp_path, monkeypatch):
    """Keys of every sort, absent ones too, from shards that are named by what they hold."""
    rows = [(i, f"word{i} and more") for i in range(-5, 300)] + [(7, "again"), (7, "again"), (None, "nothing"), (2**62, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2, partitions=4)
    every = [(r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_token_files(spark, path).collect()]
    assert len(every) == len(rows)
    keys = [7, None, -5, 299, 300, 2**62, -(2**60), 150, 7]
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_keys(spark, path, keys).collect()]
    assert sorted(map(repr, got)) == sorted(repr(r) for r in every if r[0] in keys) and len(got) == 8
    assert token_files.read_keys(spark, path, [12345]).count() == 0
