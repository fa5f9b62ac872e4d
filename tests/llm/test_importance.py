"""Importance resampling against a plain version, and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tarnspark.llm import importance as imp

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets, longest=3):
    ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(ws), sorted(zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1))


def plain(rows, target, percent, min_words, buckets=10_000):
    """(id, n_words, n_features, weight, score, rank) of rows (id, text)."""
    bags = [(i, *features(t, buckets)) for i, t in rows]
    s, t = Counter(b for *_, bs in bags for b in bs), Counter(b for x in target for b in features(x, buckets)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, bs in bags:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in bs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = [(*r, k) for k, r in enumerate(may, 1) if k <= percent * len(may) // 100]
    left = Counter(out) - Counter(r[:5] for r in drawn)
    return sorted([*drawn, *((*r, None) for r in left.elements())], key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abCÉé09") for _ in range(draw.randint(1, 3)))
    text = lambda n: " ".join(word() + draw.choice(["", ".", "\n", "-"]) for _ in range(n))
    out = [(i, text(draw.randint(0, 60))) for i in range(120)] + [(None, text(40)), (None, None), (7, ""), (500, " .,\x00\n"), (501, text(30_000))]
    return out + out[:3] + [out[5]] * 20


def test_block_bags(rows):
    ids = imp.WordIds()
    for longest in (1, 2, 3, 5):
        for at in range(0, len(rows), 7):
            texts = [t for _, t in rows[at : at + 7]]
            got = imp.block_bags(texts, ids, 1000, longest)
            assert [(n, imp.bag_buckets(b).tolist()) for n, _, b in got] == [features(t, 1000, longest) for t in texts]
            assert all(f == len(b) // 2 for _, f, b in got)
    assert imp.block_bags([], ids) == []


def test_draw(spark, rows, monkeypatch):
    monkeypatch.setattr(imp, "DICTIONARY_BYTES", 1000)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, rank string, own string, bag int")
    target = ["ab ab ca 00 99 b", None, "", "É é"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = imp.draw(imp.importance(docs.repartition(5), bench), percent=30, min_words=10).collect()
    assert sorted([(r["id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out], key=repr) == plain(rows, target, 30, 10)
    assert {tuple(r["original"])[2:] for r in out} == {("x", "y", 1)}
    drawn = imp.resample(docs, bench, percent=30, min_words=10)
    assert drawn.columns == docs.columns and drawn.count() == sum(r["rank"] is not None for r in out)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)] * 30, "doc_id long, text string")
    assert imp.draw(imp.importance(none, some)).count() == 0 and imp.resample(some, none, percent=10).count() == 3
    with pytest.raises(ValueError):
        imp.importance(some, some, buckets=1 << 17)
