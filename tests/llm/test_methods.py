"""The operators' own paths on small planted tables: large buckets, hot minimizers, pairs near the threshold, damaged archives, pruned blocks."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tarnspark.llm import topk
from tarnspark.llm.common import Remembered
from tarnspark.llm.fm_index import FMIndex
from tarnspark.llm.near_dedup import near_duplicates
from tarnspark.llm.substring_dedup import dedup_substrings

from . import brute


def some_words(rng, n, kinds=5000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def varied(rng, ws, changes):
    out = list(ws)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def test_remembered_is_bounded():
    made = []
    memory = Remembered(lambda k: made.append(k) or k.encode(), 40_000)
    for i in range(5000):
        assert memory[f"key {i}"] == f"key {i}".encode()
        assert (len(memory) + len(memory.elder)) * Remembered.ENTRY <= 40_000
    before = len(made)
    assert memory["key 4999"] and len(made) == before
    assert memory["y" * 70] and memory["y" * 70] and len(made) == before + 2


def test_fm_index_finds_repeated_windows():
    rng = np.random.default_rng(5)
    for _ in range(60):
        seqs = list({x.tobytes(): x for x in (rng.integers(1, 5, rng.integers(1, 16)).astype(np.uint64) for _ in range(6))}.values())
        often, window = rng.integers(0, 2, len(seqs)) == 1, int(rng.integers(1, 6))
        found = FMIndex(seqs, often, 20).repeats(seqs, window, chunk=int(rng.integers(1, 50)))
        got = {(w, i) for w, a, b in zip(*map(np.ndarray.tolist, found), strict=True) for i in range(a, b - window + 1)}
        times = Counter()
        for x, m in zip(seqs, often, strict=True):
            for i in range(len(x) - window + 1):
                times[x[i : i + window].tobytes()] += 1 + bool(m)
        assert got == {(j, i) for j, x in enumerate(seqs) for i in range(len(x) - window + 1) if times[x[i : i + window].tobytes()] > 1}


@pytest.mark.parametrize("hot", [1, 512])
def test_hot_minimizers(spark, hot):
    """With hot=1 every shared minimizer is dealt window by window."""
    rng = random.Random(3)
    passage = some_words(rng, 50)
    texts = [" ".join(some_words(rng, rng.randrange(5, 40)) + passage[rng.randrange(8) : 50 - rng.randrange(8)] + some_words(rng, rng.randrange(30))) for _ in range(30)]
    texts += [" ".join(some_words(rng, 90)) for _ in range(10)] + [texts[0], " ".join(["a", "b"] * 200)]
    windows = Counter(tuple(w[i : i + 35]) for w in map(str.split, texts) for i in range(len(w) - 34))
    want = []
    for t in texts:
        w = t.split()
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["n_removed"], bytes(r["kept"]).decode()) for r in dedup_substrings(docs, hot_stretches=hot).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_buckets_of_many_blocks_and_recall(spark):
    """A group of 60 variants, looked at in blocks of 4, and 100 pairs of similarity 0.80 to 0.85: none is missed, and pairs of 0.70 to
    0.79 are not linked."""
    rng = random.Random(11)
    texts = []
    base = some_words(rng, 300)
    texts += [" ".join(varied(rng, base, rng.randrange(12))) for _ in range(60)]
    for i in range(150):  # changed words cost two shingles each: (300 - 2c) / (300 + 2c)
        own = some_words(rng, 301, 10**6)
        texts += [" ".join(own), " ".join(varied(rng, own, rng.randrange(13, 17) if i < 100 else rng.randrange(19, 24)))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in near_duplicates(docs, width=2, block=4).collect()}
    want, _ = brute.near_components(sorted(rows), 2, 80)
    assert [got[i] for i, _ in sorted(rows)] == want


def test_blocks_are_pruned(spark):
    """Vectors of 40 tight groups and 1,000 loose, shorter ones: results equal brute force, and most blocks are never visited."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.concatenate([np.repeat(centres, 60, 0) + 0.005 * rng.standard_normal((2400, 32)), 0.05 * rng.standard_normal((1000, 32))])
    rng.shuffle(x)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, visited, blocks = topk.search(vectors, vectors.where("vec_id % 25 = 0"), 5)
    v = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(0, len(x), 25):
        scores = v @ v[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -scores)) if j != i][:5]
        want += [(i, n, int(j), int(scores[j])) for n, j in enumerate(order, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    n_blocks, n_queries = blocks.count(), len(want) // 5
    assert n_blocks >= 20 and visited.distinct().count() == visited.count()
    assert visited.count() < 0.5 * n_blocks * n_queries
