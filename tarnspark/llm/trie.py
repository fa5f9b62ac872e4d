"""The prefix trie of conversations, by chained digests.

A conversation's prefix of d turns is told by a SHA-256 chain over its turns. Every prefix is a row; rows of equal (depth, digest) are one
node, and its members are the conversations that begin with it. Sums over subtrees come from handing each node to all its
ancestors. These are the shorter prefixes of any member, so the smallest member carries its nodes there along its own row of prefixes,
summed on the way: as many rows as prefixes, however deep a node lies.

Work that has to follow a conversation's order goes by parts of it, so that no task needs a whole conversation, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, saved, skew_join

#: Turns that one row chains, and prefixes of a part whose sums one window task makes.
CHAIN, PART = 64, 4096
#: Bytes of conversation ids in a row, about.
ENDS_BYTES = 1 << 20
_STEPS = "array<struct<pos:bigint,prefix:binary,chars:bigint>>"


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv, pos from 1, digest, chars; conversations: conv, n_turns), from rows of conv_id, turn, role, text.

    Turns are ordered by turn, null first, then by the digest of role and text; a null role or text is empty, repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation and are left out. Other columns are ignored.
    """
    t = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("conv"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest"), F.monotonically_increasing_id()]
    placed = numbered(t, order, "trie-turns").select("conv", "digest", "chars", "at")
    convs = saved(placed.groupBy("conv").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n_turns")), "trie-conversations")
    rows = skew_join(placed, convs.select("conv", "first"), ["conv"], "inner", "trie-first")
    return rows.select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), "digest", "chars"), convs.select("conv", "n_turns")


def with_shared_heads(turns: DataFrame, convs: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """ordered_turns' pair, with every conversation c begun anew: the first h turns of conversation c - c % group (all if it has fewer, none if it
    is not there), then c's own turns after its first h; h = unsigned crc32(decimal c) % most."""
    c = convs.select("conv", "n_turns", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    c = c.join(convs.select(F.col("conv").alias("base"), F.col("n_turns").alias("n_base")), "base", "left")
    k = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    c = saved(c.select("conv", "base", "h", k.alias("k"), (k + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n")), "trie-heads")
    turns = saved(turns, "trie-positions")
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    copied = c.where("k > 0").join(heads, "base").where(F.col("pos") <= F.col("k")).select("conv", "pos", "digest", "chars")
    own = skew_join(turns, c.select("conv", "h", "k"), ["conv"], "inner", "trie-own").where(F.col("pos") > F.col("h"))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "chars")
    return copied.unionByName(own), c.select("conv", F.col("n").alias("n_turns"))


def prefixes(items: DataFrame, longest: int) -> DataFrame:
    """(conv, pos, prefix, chars) of items (conv, pos from 1, digest, chars); longest: the largest pos.

    x(i) = SHA-256(x(i-1), digest(i)) within parts of CHAIN items; what stands before a part is chained in the same way from the
    parts' last x, and hashed in front. So a prefix hangs on its own items alone, and a row holds CHAIN items at most.
    """
    step = lambda acc, x: F.unhex(F.sha2(F.concat(acc["last"], x["digest"]), 256))

    def grow(acc: Column, x: Column) -> Column:
        new = step(acc, x)
        return F.struct(F.array_append(acc["steps"], F.struct(x["pos"].alias("pos"), new.alias("prefix"), x["chars"].alias("chars"))).cast(_STEPS).alias("steps"), new.alias("last"))

    part = F.floor((F.col("pos") - 1) / CHAIN).cast("long")
    grouped = items.groupBy("conv", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("items"))
    start = F.struct(F.array().cast(_STEPS).alias("steps"), F.unhex(F.lit("")).alias("last"))
    chained = grouped.select("conv", "part", F.aggregate("items", start, grow, lambda acc: acc["steps"]).alias("steps"))
    if longest > CHAIN:
        chained = saved(chained, "trie-chains")
    out = chained.select("conv", "part", F.explode("steps").alias("s")).select("conv", "part", "s.pos", "s.prefix", "s.chars")
    if longest > CHAIN:
        ends = chained.select("conv", (F.col("part") + 1).alias("pos"), F.element_at("steps", -1)["prefix"].alias("digest"), F.lit(0).cast("long").alias("chars"))
        before = prefixes(ends, (longest + CHAIN - 1) // CHAIN).select("conv", F.col("pos").alias("part"), F.col("prefix").alias("before"))
        out = out.join(before, ["conv", "part"], "left")
        out = out.withColumn("prefix", F.when(F.col("before").isNull(), F.col("prefix")).otherwise(F.unhex(F.sha2(F.concat("before", "prefix"), 256))))
    return out.select("conv", "pos", "prefix", "chars")


def _from_below(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows (conv, pos, ...) with each named column summed over the conversation from the row's pos on."""
    part = rows.withColumn("part", F.floor(F.col("pos") / PART))
    inside = Window.partitionBy("conv", "part").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("conv", "part").agg(*[F.sum(x).alias(x) for x in names])
    sums = sums.select("conv", "part", *[F.coalesce(F.sum(x).over(later), F.lit(0)).alias(f"{x}_later") for x in names])
    out = part.withColumns({x: F.sum(x).over(inside) for x in names}).join(sums, ["conv", "part"])
    return out.select(*[c for c in rows.columns if c not in names], *[(F.col(x) + F.col(f"{x}_later")).alias(x) for x in names])


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbouring rows of a node, in order of conv, become rows of comma-joined ids of ENDS_BYTES at most, cut where a batch ends."""
    for b in batches:
        edges = [0, *(i for i in range(1, len(b)) if b["prefix"].iat[i] != b["prefix"].iat[i - 1]), len(b)] if len(b) else [0]
        rows = []
        for start, end in zip(edges, edges[1:], strict=False):
            for at in range(start, end, ENDS_BYTES // 20):
                ids = b["conv"].iloc[at : min(end, at + ENDS_BYTES // 20)]
                rows.append((b["prefix"].iat[start], int(ids.iat[0]), ",".join(map(str, ids))))
        yield pd.DataFrame(rows, columns=["prefix", "conv", "ids"])


def _ends_hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest a node over its rows of ids, which follow each other, in order; only a digest's state is held."""
    node, state = None, None
    for b in batches:
        done = []
        for prefix, ids in zip(b["prefix"], b["ids"], strict=True):
            if prefix == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((node, state.hexdigest()))
            node, state = prefix, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["prefix", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["prefix", "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of rows (prefix, conv): SHA-256 of each prefix's decimal ids, ascending, comma-joined. A node of very many ids is dealt by ranges of
    them; one task hashes their joined text, as SHA-256 has no other way, and holds a row of it at a time."""
    dealt = last.repartitionByRange("prefix", "conv").sortWithinPartitions("prefix", "conv")
    joined = dealt.mapInPandas(_joined_ids, "prefix binary, conv long, ids string")
    return joined.repartition("prefix").sortWithinPartitions("prefix", "conv").mapInPandas(_ends_hashed, "prefix binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, pos from 1 without gaps, digest, chars (of the turn's text); convs: conv, n_turns, each conversation once, those
    without turns too. The root, of depth 0, has all of them; without conversations there is no node. saved_tokens sums, over the subtree, a
    node's members but one times the characters of its last turn; n_leaves counts the subtree's childless nodes.
    """
    longest = convs.agg(F.max("n_turns")).first()[0]
    root = F.unhex(F.sha2(F.lit(b"root"), 256))
    path = convs.select("conv", F.lit(0).cast("long").alias("pos"), root.alias("prefix"), F.lit(0).cast("long").alias("chars"))
    if longest:
        path = path.unionByName(prefixes(turns, longest))
    path = saved(path, "trie-path")
    # A node is childless if as many conversations end at it as have it.
    last = path.join(convs.select("conv", F.col("n_turns").alias("pos")), ["conv", "pos"], "left_semi").select("pos", "prefix", "conv")
    n_ends = last.groupBy("pos", "prefix").agg(F.count(F.lit(1)).alias("n_ends"))
    nodes = path.groupBy("pos", "prefix").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"))
    nodes = saved(nodes.join(n_ends, ["pos", "prefix"], "left"), "trie-nodes")
    # What a node gives, laid on its smallest member's prefixes: its own there, and a child one turn above.
    own = F.struct("pos", ((F.col("n") - 1) * F.col("chars")).alias("saved"), F.col("n_ends").eqNullSafe(F.col("n")).cast("long").alias("leaves"), F.lit(0).cast("long").alias("children"))
    above = F.struct((F.col("pos") - 1).alias("pos"), *[F.lit(n).cast("long").alias(x) for x, n in (("saved", 0), ("leaves", 0), ("children", 1))])
    gifts = nodes.select("conv", F.explode(F.array(own, above)).alias("gift")).select("conv", "gift.*").where("pos >= 0")
    gifts = gifts.groupBy("conv", "pos").agg(*[F.sum(x).alias(x) for x in ("saved", "leaves", "children")], F.sum(F.lit(1) - F.col("children")).alias("is_least"))
    laid = path.join(gifts, ["conv", "pos"], "left").na.fill(0, ["saved", "leaves", "children", "is_least"])
    laid = saved(laid.select("conv", "pos", "prefix", "saved", "leaves", "children", "is_least"), "trie-laid")
    whole = _from_below(laid, ("saved", "leaves")).groupBy("pos", "prefix").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    # Where a node's smallest member is not its parent's, the parent is met by its digest; else it has the same.
    tops = laid.where("children > 0 AND is_least = 0").select("pos", "prefix", F.col("conv").alias("conv_id"))
    tops = skew_join(saved(tops, "trie-tops"), nodes.select("pos", "prefix", F.col("conv").alias("parent")), ["pos", "prefix"], "inner", "trie-parents")
    out = whole.join(tops.select("conv_id", (F.col("pos") + 1).alias("pos"), "parent"), ["conv_id", "pos"], "left").join(_ends(last.select("prefix", "conv")), "prefix", "left")
    parent = F.when(F.col("pos") > 0, F.coalesce("parent", "conv_id"))
    names = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.select("conv_id", F.col("pos").alias("depth"), parent.alias("parent_conv_id"), *[F.col(x).cast("long").alias(x) for x in names], F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """prefix_trie() of the conversations of rows (conv_id, turn, role, text), as ordered_turns() reads them."""
    ordered, convs = ordered_turns(turns)
    return prefix_trie(saved(ordered, "trie-positions"), convs)
