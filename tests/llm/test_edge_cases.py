"""Nulls, empty and repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import gzip
import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnspark.llm.byte_bpe import decode_documents, encode_documents
from tarnspark.llm.chat import render_chats
from tarnspark.llm.line_dedup import dedup_lines
from tarnspark.llm.mixing import entropy, mix_sources, mixed_documents, solve_mix
from tarnspark.llm.near_dedup import near_duplicates, without_near_duplicates
from tarnspark.llm.quality import judge_documents, line_passes
from tarnspark.llm.substring_dedup import dedup_substrings
from tarnspark.llm.token_files import round_trip as token_round_trip
from tarnspark.llm.topk import top_k
from tarnspark.llm.warc import pages_of, read_archives, record, round_trip, salvage, write_archives

LONG = " ".join(f"w{i}" for i in range(60))
SCHEMA = "doc_id long, text string, source string, row string, id string, original string, key string, n_tokens string, __row string, __kind string, __times string, kind string"
ROWS = [
    (1, LONG, "a"), (2, LONG + " tail", "a"), (2, LONG + " tail", "a"), (3, None, "b"), (4, "", None), (None, "one two", None),
    (None, None, None), (5, " \t\n\x0b ", "b"), (6, "Same\n same \nother.", "b"), (7, "é " * 50_000, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *"vwxyzqabc") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, no_docs):
    out = dedup_lines(docs, min_docs=2).select("original.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert len(out) == len(ROWS)
    got = {r["doc_id"]: r for r in out if r["doc_id"]}
    assert (got[2]["n_lines"], got[2]["n_dropped"], got[2]["kept_text"]) == (1, 1, "")
    assert (got[6]["n_lines"], got[6]["n_dropped"]) == (3, 0)
    assert (got[3]["n_lines"], got[3]["n_dropped"], got[3]["kept_text"]) == (1, 0, "")
    assert dedup_lines(no_docs).count() == 0


def test_line_dedup_of_a_document_that_loses_many_lines(spark):
    shared = [f"line {i}" for i in range(400)]
    rows = [(1, "\n".join(x for i in range(400) for x in (shared[i], f"own {i}"))), (2, "\n".join(shared)), (2, "\n".join(shared)), (3, None)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3, batches=2).select("original.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, out)) == [(1, 800, 400, "\n".join(f"own {i}" for i in range(400))), (2, 400, 400, ""), (2, 400, 400, ""), (3, 1, 0, "")]


def test_quality(docs, no_docs):
    out = {r["doc_id"]: r for r in judge_documents(docs).select("original.doc_id", "verdict.*").collect()}
    assert out[3]["base_failed"] and not out[3]["kept"] and out[3]["n_words"] == 0
    assert out[7]["n_words"] == 50_000 and out[7]["n_repeat_words"] == 50_000
    assert not out[1]["base_failed"] and out[1]["kept"]  # no sentence mark, but too long for a fragment
    assert judge_documents(no_docs).count() == 0


def test_clean_lines_pass(spark):
    """Sentences that hold a phrase, or parts of one, and lines of a wrapped paragraph stay; lines that are mostly boilerplate go."""
    clean = ["She moved from design in Paris to a new firm.", "The blog in question was long gone.", "He read more books than anyone.", "Die Firma nennt im Impressum eine Adresse in Berlin, die es nicht gibt.", "these words of a wrapped paragraph run on to the"]
    junk = ["Read more", "Log in | Sign up", "Alle Rechte vorbehalten.", "Cliquez ici !", "Política de cookies.", "a heading without end"]
    for line in clean:
        assert line_passes(line, len(line.split()), len(line.replace(" ", ""))), line
    for line in junk:
        assert not line_passes(line, len(line.split()), len(line.replace(" ", ""))), line


def test_near_duplicates(docs, no_docs):
    out = near_duplicates(docs, width=2).collect()
    assert len(out) == len(ROWS)
    assert {r["component_id"] for r in out if r["id"] in (1, 2)} == {1}
    assert {(r["id"], r["n_shingles"], r["component_id"]) for r in out if r["id"] in (3, 4, 5)} == {(3, 0, 3), (4, 0, 4), (5, 0, 5)}
    kept = without_near_duplicates(docs, width=2)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.select("row", "__row").distinct().collect()] == [("v", "q")]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 4, 5, 6, 7]
    assert near_duplicates(no_docs).count() == 0 and without_near_duplicates(no_docs).count() == 0


def test_substrings(docs, no_docs):
    out = dedup_substrings(docs).collect()
    assert len(out) == len(ROWS)
    got = {r["id"]: r for r in out if r["id"]}
    assert (got[1]["n_words"], got[1]["n_removed"], bytes(got[1]["kept"])) == (60, 60, b"")
    assert got[2]["n_removed"] == 61  # its two rows repeat each other
    assert got[7]["n_removed"] == 50_000
    assert (got[3]["n_words"], got[6]["n_removed"]) == (0, 0)
    assert dedup_substrings(no_docs).count() == 0


def test_mixing(docs, no_docs):
    uses = mix_sources(docs, max_repeat=3.0).collect()
    assert {r["id"] for r in uses} >= {1, 2, 3, 4, 5, 6, 7}
    assert {r["copies"] for r in uses if r["id"] == 2} == {2}
    mixed = mixed_documents(docs, max_repeat=1.0)
    assert mixed.columns == docs.columns and mixed.count() == len(ROWS)
    assert [tuple(r) for r in mixed.select("row", "__row", "__kind", "__times", "kind").distinct().collect()] == [("v", "q", "a", "b", "c")]
    assert mix_sources(no_docs, max_repeat=2.0).count() == 0
    level = solve_mix({"a": 900, "b": 100}, target_entropy=0.5)
    weights = {k: v / level.total for k, v in level.budgets.items()}
    sharp = solve_mix({"a": 900, "b": 100}, target_entropy=0.1)
    assert sharp.exponent > 1 and abs(entropy({k: v / sharp.total for k, v in sharp.budgets.items()}) - 0.1) < 1e-2
    for impossible in ({"target_entropy": 0.8}, {"max_repeat": 2, "budget": 10_000}):
        with pytest.raises(ValueError):
            solve_mix({"a": 900, "b": 100}, **impossible)
    assert 0 < level.exponent < 1 and abs(-sum(w * __import__("math").log(w) for w in weights.values()) - 0.5) < 1e-2


def test_byte_bpe(docs, no_docs):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode_documents(encode_documents(docs, ranks, pattern), ranks, pattern)
    assert out.where(F.coalesce(F.col("original.text"), F.lit("")) != F.col("decoded").cast("string")).count() == 0
    assert out.where("n_tokens = 0").count() == 3
    assert encode_documents(no_docs, ranks, pattern).count() == 0


def test_token_files(docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = token_round_trip(docs, path, 2).orderBy("start").collect()
    assert len(out) == len(ROWS)
    assert [r["doc_id"] for r in out[:2]] == [None, None]
    start = 0
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
    assert token_round_trip(no_docs, path, 2).count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "block": F.lit(1)})
    got = top_k(vectors, vectors.where("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 32768), (2, 32768), (2, 32768)]
    got = top_k(vectors, vectors.where("vec_id = 2"), k=2).orderBy("query_id", "rank", "vec_id").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(2, 1, 0), (2, 1, 0), (2, 2, 1), (2, 2, 1)]  # two rows of one id, each the other's candidate
    got = top_k(vectors, vectors.where("vec_id = 2"), k=9).where("vec_id = 2").collect()
    assert len(got) == 2
    assert top_k(vectors.where("vec_id < 0"), vectors.where("vec_id < 0"), k=5).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (None, 0, None, None), (4, None, "user", "x"), (4, None, "user", "x"), (None, 7, "user", "hi")]
    rows += [(5, i, "user", str(i)) for i in range(9000)] + [(6, i, "user", str(i)) for i in range(8500)] + [(7, 3, "user", "b"), (7, 3, "user", "a"), (7, 3, None, "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("x"), "pos": F.lit(1)})
    got = {r["conv_id"]: r for r in render_chats(turns).collect()}
    assert set(got) == {1, None, 4, 5, 7}  # 6 is a prefix of 5, and the null row "hi" one of 1
    assert got[5]["n_turns"] == 9000 and got[5]["text"].endswith("8999<|end|>\n")
    assert got[7]["text"] == "<|unknown|>\nc<|end|>\n<|user|>\na<|end|>\n<|user|>\nb<|end|>\n"
    assert (got[1]["n_copies"], got[1]["n_turns"], got[1]["text"]) == (2, 2, "<|user|>\nhi<|end|>\n<|bot|>\nyes<|end|>\n")
    assert got[None]["text"] == "<|unknown|>\n<|end|>\n" and got[4]["n_turns"] == 1
    assert render_chats(turns.where("conv_id = 99")).count() == 0


def test_warc_round_trip(spark):
    big = "x" * 150
    rows = [(2, "http://a b", big), (1, None, big), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (None, "u", big), (6, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {r["page_id"]: r for r in round_trip(pages).collect()}
    assert len(got) == len(rows)
    assert (got[1]["record_type"], got[2]["record_type"], got[2]["refers_to"], got[None]["refers_to"]) == ("response", "revisit", 1, 1)
    assert got[2]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and got[2]["payload_bytes"] == 150
    assert {got[i]["record_type"] for i in (3, 4, 5, 6)} == {"response"}
    assert round_trip(pages.where("page_id > 99")).count() == 0


def test_warc_salvage(spark, tmp_path):
    members = [record(i, f"u{i}", f"payload {i}".encode() * 40, hashlib.sha256(f"payload {i}".encode() * 40).hexdigest(), None) for i in range(4)]
    broken = members[1][:40] + b"\x00" * 9 + members[1][49:]
    plain = gzip.decompress(members[3])
    data = members[0] + broken + members[2] + b"noise\n" + plain
    found = list(salvage(data))
    assert [x["kind"] for x in found] == ["record", "gap", "record", "gap", "record"]
    assert [(x["start"], x["end"]) for x in found if x["kind"] == "gap"] == [(len(members[0]), len(members[0] + broken)), (len(members[0] + broken + members[2]), len(data) - len(plain))]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(data[:-5])
    rows = read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted(r["kind"] for r in rows) == ["gap", "gap", "record", "record"]
    pages = spark.createDataFrame([(1, "u", "z" * 200)], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "b"))
    assert pages_of(read_archives(spark, str(tmp_path / "b"))).count() == 1
