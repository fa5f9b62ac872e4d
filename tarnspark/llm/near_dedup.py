"""MinHash near-dedup with sequential Bayesian verification.

Documents of equal shingle sets form a class. Class signatures are banded; classes that share a band's bucket are candidates.
Signatures of candidates are compared batch by batch, and a pair is pruned as soon as the posterior odds that its similarity
reaches the threshold fall below a chosen miss probability. Survivors are verified on their full shingle sets.

Buckets are never expanded into all pairs. First each class is verified with its best partner among the least members
of its buckets, which joins most of a group; then buckets whose members still lie in several components are
compared block by block: pairs between components that survive are tried on hashed sets, and each task returns a spanning
forest of links, which are verified in turn. That is repeated until no link between components is left, so links decide
as if all candidates had been verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, row_key, saved, skew_join

#: Bands of ROWS hashes: a pair of similarity 0.8 shares no band with odds of (1 - 0.8 ** 4) ** 32, below 1e-7.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature hashes compared before each posterior test, and the odds below which a pair is pruned.
BATCHES, MISS = (16, 32, 64, 128), 1e-8
#: Members of a block of a bucket, and bytes of their hashed sets, at most (about, as members are dealt by hash).
BLOCK, BLOCK_BYTES = 1024, 16 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Signer:
    """Hashes of shingle sets, and their MinHash signatures."""

    def __init__(self, width: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.width = width
        self.factor = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
        self.offset = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        n = len(h) - self.width + 1
        if n < 1:
            return np.fromiter([xxhash.xxh64_intdigest(b"\x00".join([b"short", *words]))] if words else [], np.uint64)
        out = h[:n].copy()
        for k in range(1, self.width):
            out = _mix(out) + h[k : n + k]
        return np.unique(_mix(out))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(hashes), 256):
            h = hashes[at : at + 256, None] * self.factor
            h += self.offset
            h >>= _U(32)
            np.minimum(best, h.min(0).astype(np.uint32), out=best)
        return best


def least_matches(threshold: float) -> list[int]:
    """For each of BATCHES, the least number of equal hashes with which a pair goes on. The prior of the similarity is uniform,
    so the odds that it reaches t after m of n equal hashes are those of a binomial (n + 1, t) being at most m."""
    out = []
    for n in BATCHES:
        total, m = 0.0, -1
        while total < MISS and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def pair_matches(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and b that survive all tests, and their equal hashes. a and b: one signature a row."""
    count = np.zeros((len(a), len(b)), np.uint8)
    for k in range(BATCHES[0]):
        count += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(count >= least[0])
    m, done = count[i, j].astype(np.int32), BATCHES[0]
    for n, need in zip(BATCHES[1:], least[1:], strict=True):
        out = np.zeros(len(i), np.int32)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            out[part] = (a[i[part], done:n] == b[j[part], done:n]).sum(1)
        m, done = m + out, n
        keep = m >= need
        i, j, m = i[keep], j[keep], m[keep]
    return i, j, m


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint32).reshape(len(column), HASHES)


def similar_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _signed(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(width)
        for batch in batches:
            sets = [signer.hashes(words_of(t)) for t in batch["text"]]
            yield pd.DataFrame({
                "row": batch["row"], "id": batch["id"], "n": [len(x) for x in sets],
                "node": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                "sig": [signer.signature(x).tobytes() if len(x) else None for x in sets],
            })

    d = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.mapInPandas(sign, "row binary, id long, n long, node binary, sig binary")


def components(edges: DataFrame, label: str = "near") -> DataFrame:
    """(node, comp): the least node that edges (a, b) reach from each node, by rounds of least neighbours and label jumps."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.distinct(), f"{label}-both")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), f"{label}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        stepped = saved(stepped.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), f"{label}-labels")
        labels = stepped.select("node", "comp")
        if stepped.where(F.col("old") != F.col("comp")).isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame, label: str = "near") -> DataFrame:
    """labels (node, comp) after further links (a, b): the components that links join, and only those, are labelled anew."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).where("a != b")
    new = components(between, label).select(F.col("node").alias("comp"), F.col("comp").alias("joined"))
    return saved(labels.join(new, "comp", "left").select("node", F.coalesce("joined", "comp").alias("comp")), f"{label}-labels")


def _verified(edges: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """edges (a, b) with linked: whether their full sets are similar enough."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: dict[bytes, set] = {}

        def shingles(node: bytes, text: str) -> set:
            if node not in recent:
                if len(recent) >= 8:
                    recent.pop(next(iter(recent)))
                recent[node] = shingle_set(words_of(text), width)
            return recent[node]

        for batch in batches:
            linked = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                x, y = shingles(bytes(a), ta), shingles(bytes(b), tb)
                both = len(x & y)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})

    own = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return own.select("a", "b", "ta", "tb").mapInPandas(verify, "a binary, b binary, linked boolean")


def _star_tester(least: list[int], percent: int) -> Callable:
    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = _sigs(batch["sa"]), _sigs(batch["sb"])
            keep = similar_sizes(batch["na"].to_numpy(), batch["nb"].to_numpy(), percent)
            for n, need in zip(BATCHES, least, strict=True):
                at = np.flatnonzero(keep)
                m = (a[at, :n] == b[at, :n]).sum(1)
                keep[at] = m >= need
            out = batch.loc[keep, ["a", "b"]]
            yield out.assign(m=(a[keep] == b[keep]).sum(1).astype(np.int64))

    return test


def _small_sets(width: int):
    """(node, small): the sorted distinct 32-bit hashes of a text's shingles."""

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(width)
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "small": [np.unique((signer.hashes(words_of(t)) >> _U(32)).astype(np.uint32)).tobytes() for t in batch["text"]]})

    return small


def _apart(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks whose pairs are all pairs of p and q but those inside p's largest component."""
    names, sizes = np.unique(label[p], return_counts=True)
    main = names[sizes.argmax()] if len(p) else -1
    return [(p[label[p] == main], q[label[q] != main]), (p[label[p] != main], q)]


def _block_forest(least: list[int], percent: int) -> Callable:
    """Of blocks of buckets: links between components, a spanning forest of them. Pairs that survive the posterior tests are tried
    on their small sets, most equal hashes first, with room for chance collisions. A pair that shares several
    bands is tried in the first of them only."""

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["band", "code"], kind="stable").reset_index(drop=True)
        sigs, sizes = _sigs(group["sig"]), group["n"].to_numpy()
        nodes, comps = [bytes(x) for x in group["node"]], [bytes(x) for x in group["comp"]]
        sets = [np.frombuffer(x, np.uint32) for x in group["small"]]
        failed = [{bytes(y) for y in ys} if ys is not None else () for ys in group["failed"]]
        mine, left, right, bands = (group[c].to_numpy() for c in ("mine", "i", "j", "band"))
        label = np.unique(np.array(comps, object), return_inverse=True)[1]
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        codes = group["code"].to_numpy()
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (bands[1:] != bands[:-1])) + 1
        for own in np.split(np.arange(len(group)), edges):
            p, q = own[mine[own] == left[own]], own[mine[own] == right[own]]
            found = []
            for x, y in _apart(label, p, q):
                i, j, m = pair_matches(sigs[x], sigs[y], least)
                i, j = x[i], y[j]
                keep = similar_sizes(sizes[i], sizes[j], percent) & (label[i] != label[j])
                if left[own[0]] == right[own[0]]:
                    i, j = np.minimum(i, j), np.maximum(i, j)
                found.append((i[keep], j[keep], m[keep]))
            i, j, m = (np.concatenate(x) for x in zip(*found, strict=True))
            for at in np.argsort(-m, kind="stable"):
                x, y = i[at], j[at]
                a, b = find(comps[x]), find(comps[y])
                if a == b or nodes[y] in failed[x]:
                    continue
                if (sigs[x].reshape(BANDS, ROWS) == sigs[y].reshape(BANDS, ROWS)).all(1).argmax() != bands[x]:
                    continue
                hidden = sizes[x] - len(sets[x]) + sizes[y] - len(sets[y])  # shared shingles that collisions may hide
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True)) + hidden
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    root[max(a, b)] = min(a, b)
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    return forest


def _compared(placed: DataFrame, block: int) -> DataFrame:
    """Where members (band, code, node, n, comp) are compared: a row (band, code, node, comp, lot, mine, i, j) for each pair of blocks, i
    and j, that a member's own block, mine, is part of. Buckets within one component drop out.

    A bucket's members outside its main component are dealt into blocks of their own, which meet each other and the blocks of
    the main component; those do not meet each other. So the rows of a hot component are copied as often as there are blocks
    of outsiders, not as there are blocks of its own. Small buckets are one block each, and share lots.
    """
    key = ["band", "code"]
    sizes = placed.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"))
    sizes = sizes.groupBy(*key).agg(F.max(F.struct("size", "comp", "held")).alias("main"), F.sum("size").alias("size"), F.sum("held").alias("held")).where("size > main.size")
    blocks = lambda rows, sets: F.greatest(F.ceil(rows / block), F.ceil(sets * 4 / BLOCK_BYTES)).cast("int")
    sizes = sizes.select(*key, F.col("main.comp").alias("main"), blocks(F.col("size"), F.col("held")).alias("all"), blocks(F.col("main.size"), F.col("main.held")).alias("inner"), blocks(F.col("size") - F.col("main.size"), F.col("held") - F.col("main.held")).alias("outer"))
    part = saved(placed.join(sizes, key), "near-placed")
    total = part.agg(blocks(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)))).first()[0]
    name, whole, inside = F.xxhash64(*key), F.col("all") <= 1, F.col("comp") == F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    mine = F.when(whole, 0).when(inside, F.col("outer") + deal(F.col("inner"))).otherwise(deal(F.col("outer")))
    part = part.withColumns({"lot": F.when(whole, F.pmod(name, F.lit(total + 1))).otherwise(name), "mine": mine})
    met = F.when(whole, F.array(F.lit(0))).when(inside, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    pairs = F.transform(met, lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))
    return part.withColumn("pair", F.explode(pairs)).select(*key, "node", "comp", "lot", "mine", "pair.i", "pair.j")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, id, n_shingles, component_id) for each row of docs: documents whose sets of width-word shingles have 100 * |intersection|
    >= percent * |union| are linked, and component_id is the smallest id that links reach, the own one included.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. With fewer words than width the whole sequence is the only shingle; null,
    empty and blank texts have none and are linked with nothing. Rows of equal sets are linked, repeated rows too; null ids
    are never a component's id unless all its ids are null. Other columns are ignored; an empty table gives an empty
    result. Classes of equal sets are told by 128-bit hashes; links between classes are verified on the words. block bounds the rows of a
    bucket that one task compares with as many others; results don't depend on it.
    """
    return _grouped(docs, width, percent, id_col, text_col, block).drop("comp")


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """near_duplicates with comp, which tells components apart also where all ids are null; NULL for rows without shingles."""
    bounded_batches(docs.sparkSession)
    least = least_matches(percent / 100)
    signed = saved(_signed(docs, width, id_col, text_col), "near-signed")
    full = signed.where(F.col("node").isNotNull())
    classes = saved(full.groupBy("node").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)).alias("code")) for i in range(BANDS)])
    cells = classes.select("node", "n", F.explode(bands).alias("cell")).select("node", "n", "cell.band", "cell.code")
    buckets = saved(cells.groupBy("band", "code").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    members = saved(cells.join(buckets, ["band", "code"]).drop("size"), "near-members")
    alike = members.select("node").distinct()
    sigs = saved(classes.join(alike, "node").select("node", "n", "sig", "row"), "near-sigs")
    d = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    texts = saved(sigs.select("node", "row").join(d, "row").groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    star = members.where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    star = star.join(sigs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    star = star.join(sigs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    star = star.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(_star_tester(least, percent), "a binary, b binary, m long")
    best = star.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    tested = saved(_verified(saved(best, "near-star"), texts, width, percent), "near-tested")
    failed = tested.where("NOT linked").select("a", "b")
    labels = saved(sigs.select("node").join(components(tested.where("linked")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "near-labels")
    while True:
        sided = failed.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(failed.select(F.col("b").alias("node"), F.col("a").alias("other")))
        sided = sided.groupBy("node").agg(F.collect_set("other").alias("failed"))
        part = saved(_compared(members.join(labels, "node"), block), "near-mixed")
        small = texts.join(part.select("node").distinct(), "node", "left_semi").select("node", "text").mapInPandas(_small_sets(width), "node binary, small binary")
        state = sigs.select("node", "n", "sig").join(small, "node").join(sided, "node", "left").select("node", "n", "sig", "small", "failed")
        forest = part.join(saved(state, "near-state"), "node").groupBy("lot", "i", "j").applyInPandas(_block_forest(least, percent), "a binary, b binary")
        fresh = saved(forest.distinct(), "near-forest")
        if fresh.isEmpty():
            break
        tested = saved(_verified(fresh, texts, width, percent), "near-tested")
        labels = merged(labels, tested.where("linked"))
        wrong = tested.where("NOT linked").select("a", "b")
        if wrong.isEmpty():  # so every pair that was passed over lies in one component
            break
        failed = failed.unionByName(wrong)
    named = classes.select("node", "id").join(labels, "node")
    ids = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    ids = named.join(ids, "comp").select("node", "comp", "component_id")
    found = skew_join(full.select("row", "id", "n", "node"), saved(classes.select("node", "id").withColumnRenamed("id", "own").join(ids, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("component_id", "own").alias("component_id")), "near-ids"), ["node"], "inner", "near")
    found = found.select("row", "id", F.col("n").alias("n_shingles"), "component_id", "comp")
    lone = signed.where(F.col("node").isNull()).select("row", "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("comp"))
    return found.unionByName(lone)


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one of its id, the first of them by text if unequal rows have that id, or if all its ids
    are null; rows without shingles all stay, equal ones too. Rows equal in id and text are one row. docs' columns may have any names."""
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = _grouped(docs, width, percent, id_col, text_col, BLOCK).where(F.col("comp").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
    keep = found.groupBy("comp").agg(F.min("row").alias("row")).select("row")
    d = docs.where(~blank).select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.struct("*").alias("original"))
    one = d.join(keep, "row").dropDuplicates(["row"]).select("original.*")
    return one.union(docs.where(blank))
