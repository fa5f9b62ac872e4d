"""Chat formatting by cumulative-snapshot collapse, with DataFrame functions only.

A logged conversation that is a prefix of a longer one is a snapshot of it. Rolling prefix hashes find such snapshots;
anti-joins keep the maximal conversations, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Turn numbers of one window task, unless they repeat: a long conversation's hashes are rolled part by part.
PART = 4096
#: A prefix hash is the sum of its turns' SHA-256, each taken with its position, in lanes of 32 bits, so that no sum overflows.
LANES = tuple(f"h{i}" for i in range(8))


def _rolled(turns: DataFrame) -> DataFrame:
    """Distinct turns with pos and the hash lanes of the prefix that ends there: key, conv, role, text, pos, lanes.

    The hash rolls turn by turn within parts, and the sums of the parts before are added.
    """
    tell = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    t = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text").distinct()
    alone = F.concat_ws("\x1f", F.lit("alone"), *[tell(c) for c in ("turn", "role", "text")])
    t = t.withColumn("key", F.unhex(F.md5(F.when(F.col("conv").isNull(), alone).otherwise(F.col("conv").cast("string")))))
    t = t.withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / PART))
    order = [F.asc_nulls_first(F.col(c)) for c in ("turn", "role", "text")]
    local = t.withColumn("at", F.row_number().over(Window.partitionBy("key", "part").orderBy(*order)))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda d, names: d.select("key", "part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in names])
    sizes = earlier(t.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), ["n"])
    local = local.join(sizes, ["key", "part"]).withColumn("pos", F.col("n_before") + F.col("at"))
    digest = F.sha2(F.concat_ws("\x1f", F.col("pos").cast("string"), tell("role"), tell("text")), 256)
    local = local.withColumn("digest", digest).select("key", "part", "conv", "role", "text", "pos", *[F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(LANES)])
    inside = Window.partitionBy("key", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = local.select("key", "part", "conv", "role", "text", "pos", *[F.sum(x).over(inside).alias(x) for x in LANES])
    totals = earlier(local.groupBy("key", "part").agg(*[F.max(x).alias(x) for x in LANES]), LANES)
    return local.join(totals, ["key", "part"]).select("key", "conv", "role", "text", "pos", *[(F.col(x) + F.col(f"{x}_before")).alias(x) for x in LANES])


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with key, conv, pos, role, text and the prefix hash that ends there; kept conversations: key, n_turns, n_copies)."""
    rolled = saved(_rolled(turns), "chat-rolled")
    prefix = F.struct(*LANES)
    lengths = rolled.groupBy("key").agg(F.max_by(prefix, "pos").alias("prefix"), F.max("pos").alias("n_turns"), F.min("conv").alias("conv"))
    # Of equal conversations the smallest id stays, and one with an id before one without.
    whole = lengths.groupBy("n_turns", "prefix").agg(F.min(F.struct(F.col("conv").isNull().alias("lacks"), "conv", "key")).alias("least"), F.count(F.lit(1)).alias("n_copies"))
    whole = saved(whole.select("n_turns", "prefix", "least.key", "n_copies"), "chat-whole")
    inner = rolled.groupBy(F.col("pos").alias("n_turns"), prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n_at"))
    # A prefix that more conversations pass than end with is continued by one of them.
    longer = whole.join(inner, ["n_turns", "prefix"]).where(F.col("n_at") > F.col("n_copies")).select("n_turns", "prefix")
    return rolled, whole.join(longer, ["n_turns", "prefix"], "left_anti").select("key", "n_turns", "n_copies")


def render_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations as chat text, a row each: conv_id, n_turns, n_copies, text.

    turns: conv_id, turn, role, text; other columns are ignored. Exact repeats of a turn row count once. Turns are ordered
    by turn, then role, then text, nulls first; a null role renders as `unknown`, a null text as nothing. A turn without a
    conv_id is a conversation of its own, as nothing tells what it belongs to. Of equal conversations the one of the
    smallest conv_id stays, one without an id only if all are, and n_copies says how many there were. Conversations and
    prefixes are told by 256-bit hashes. A row is as long as its conversation.
    """
    rolled, kept = maximal_conversations(turns)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    out = rolled.select("key", "conv", "pos", line.alias("line")).join(kept, "key")
    out = out.groupBy("key", "conv", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return out.select(F.col("conv").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
