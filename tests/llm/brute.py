"""Plain versions of the operators, written apart from them, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
from collections import Counter

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tarnspark.llm.quality import BOILERPLATE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_row(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def word_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def quality(text):
    """The clean text, or None if the document is rejected."""
    ws = words(text)
    fives = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    repeated = {j for i in range(len(ws) - 4) if fives[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(ws) < 10 or 100 * len(repeated) > 20 * len(ws):
        return None
    kept, lost = [], 0
    for line in (text or "").split("\n"):
        own = words(line)
        if not own:
            continue
        n, marks = sum(map(len, own)), sum(line.count(c) for c in "|»›•·")
        bad = marks >= 2 and marks * 4 >= len(own) or len(own) < 8 and not any(c in line for c in ".!?…;:。！？") or 10 * sum(line.count(c) for c in "#*$%&|<>") >= n
        low = line.translate(LOWER)
        for p in BOILERPLATE:  # no phrase overlaps another
            low = re.sub(rf"(?<![a-z0-9_]){re.escape(p)}(?![a-z0-9_])", "\0", low)
        if bad or "\0" in low and 2 * len(words(low.replace("\0", " "))) <= len(own):
            lost += n
        else:
            kept.append(line)
    return None if 100 * lost > 50 * sum(map(len, ws)) else "\n".join(kept)


def without_frequent_lines(texts, min_docs=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or found[key(x)] < min_docs) for t in texts]


def near_components(docs, width, percent):
    """docs: (id, text). The least id that links reach, for each row."""
    sets = []
    for _, text in docs:
        ws = words((text or "").translate(LOWER))
        sets.append({tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), own), own)
    return [least[find(i)] for i in range(len(docs))], [len(s) for s in sets]


def mix(docs, max_repeat, seed):
    """docs: distinct (id, source, text). (id, source, n_tokens, epoch, block, place) of each use."""
    tokens = Counter()
    for _, source, text in docs:
        tokens[source] += len(words(text))
    total = sum(tokens.values())

    def budgets(x):
        weight = {s: (n / total) ** x for s, n in tokens.items() if n}
        weight = {s: w / math.fsum(weight.values()) for s, w in weight.items()}
        whole = max(tokens[s] / w for s, w in weight.items())
        return {s: w * whole for s, w in weight.items()}

    low, high = 0.0, 1.0
    fits = lambda x: max(b / tokens[s] for s, b in budgets(x).items()) <= max_repeat * (1 + 1e-12)
    if fits(0.0):
        high = 0.0
    for _ in range(60 if high else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    want = {s: math.floor(b + 0.5) for s, b in budgets(high).items()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for source, n in tokens.items():
        own = [(i, t, md5(f"++{source}/{i}:+{t}" if t is not None else f"++{source}/{i}:-").upper()) for i, s, t in docs if s == source]
        blocks = max(1, math.ceil(len(own) / 1024))
        epoch, left = 0, want.get(source, 0) if n else 1
        while left > 0:
            dealt = {}
            for i, t, row in own:
                order = md5(f"{seed}:{epoch}:{row}")
                dealt.setdefault(int(order[:12], 16) % blocks, []).append((order, row, i, len(words(t))))
            for block, cell in enumerate(sorted(dealt, key=lambda c: (md5(f"{seed}:{epoch}:+{source}:{c}"), c))):
                for place, (_, _, i, size) in enumerate(sorted(dealt[cell]), 1):
                    if left > 0 or not n:
                        out.append((i, source, size, epoch, block, place))
                        left -= size
            epoch, left = epoch + 1, left if n else 0
    return out
