"""The prefix trie against a plain version: long conversations, hot nodes, ties, nulls, repeated rows, empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tarnspark.llm import trie


def plain(turns, heads=True):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    if heads:
        whole = {}
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            whole[c] = own.get(c - int(abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + ts[h:]
    else:
        whole = own
    members = {}
    for c, ts in whole.items():
        at = ()
        members.setdefault(at, []).append(c)
        for t in ts:
            at = (*at, hash((at, t)))
            members.setdefault(at, []).append(c)
            members.setdefault(("chars", at), len(t[1]))
    chars = {k[1]: members.pop(k) for k in [k for k in members if k and k[0] == "chars"]}
    kids, below = {}, {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, ms in members.items():
        for d in range(len(k) + 1):
            n, s = below.get(k[:d], (0, 0))
            below[k[:d]] = n + (k not in kids), s + (len(ms) - 1) * chars.get(k, 0)
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(whole[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(ms), len(k), min(members[k[:-1]]) if k else -1, len(ms), kids.get(k, 0), *below[k], ends(k)) for k, ms in members.items())


def nodes(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def rebuilt(turns):
    rows, convs = trie.with_shared_heads(*trie.ordered_turns(turns))
    return trie.prefix_trie(trie.saved(rows, "t"), convs)


SCHEMA = "conv_id long, turn long, role string, text string"


def random_turns():
    draw = random.Random(11)
    rows = []
    for c in [*range(-3, 4), *range(95, 130), *range(200, 260, 7), 301, 10_099]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([None, t, t, t]), draw.choice(["user", "bot", None]), draw.choice(["a", "b", "a", "é𝄞", None])))
    for c in range(1000, 1300):  # a node that many conversations share and end at
        rows += [(c, 0, "user", "hi"), (c, 1, "bot", "yes")]
    rows += [(5000, i, "user", str(i % 3)) for i in range(70)] + [(5001, i, "user", str(i % 3)) for i in range(66)] + [(5002, i, "user", str(i % 3) if i < 64 else "z") for i in range(68)]
    rows += [(None, 0, "user", "hi"), (None, None, None, None)] + rows[:5] + [(6000, 4, "user", "same")] * 40
    return rows


def test_against_plain_version(spark, monkeypatch):
    rows = random_turns()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want, want_own = plain(rows), plain(rows, heads=False)
    assert nodes(rebuilt(turns)) == want
    monkeypatch.setattr(trie, "CHAIN", 4)  # three levels of chains, and many parts
    monkeypatch.setattr(trie, "PART", 8)
    monkeypatch.setattr(trie, "ENDS_BYTES", 200)
    assert nodes(trie.conversation_trie(turns.withColumns({"pos": F.lit("x"), "conv": F.lit("y")}))) == want_own
    monkeypatch.setattr(trie, "CHAIN", 5)
    assert nodes(rebuilt(turns)) == want


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, i, "user", f"turn {i}") for i in range(20_000)] + [(2, i, "user", f"turn {i}") for i in range(5000)] + [(3, 0, None, "x" * 1_000_000)]
    got = nodes(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 20_002
    sizes = [len(f"turn {i}") for i in range(5000)]
    assert [r[:7] for r in got if r[1] == 0] == [(1, 0, -1, 3, 2, 2, sum(sizes))]
    assert [r[:7] for r in got if r[:2] == (1, 4000)] == [(1, 4000, 1, 2, 1, 1, sum(sizes[3999:]))]
    assert [r[:7] for r in got if r[:2] == (3, 1)] == [(3, 1, 1, 1, 0, 1, 0)]


def test_empty_and_turnless(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "lost")]  # no base conversation, and its own turn is among those that are replaced
    assert nodes(rebuilt(spark.createDataFrame(rows, SCHEMA))) == plain(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
