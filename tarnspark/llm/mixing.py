"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent and normalised: 1 keeps the shares, 0 levels them. The exponent is
bisected to meet a target entropy or a repetition limit. Weights become token budgets, and budgets are realised as block
permutations: in every epoch a source's documents are dealt into blocks by hash, blocks and documents are permuted,
and whole blocks are taken until the budget is met; the last block is taken document by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, row_key, saved

STEPS = 60
#: Entropies as close as this are equal; no larger exponent is tried; a mix that uses documents of a source more often than this is refused.
CLOSE, MAX_EXPONENT, MAX_USES = 1e-9, 1024.0, 10_000
#: Documents of a block, about; the cumulated sizes of a source are of blocks, not of documents.
BLOCK_DOCS = 1024


@dataclass(frozen=True)
class Mix:
    exponent: float
    total: int
    budgets: dict


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[\\x20\\x09-\\x0D]+", -1))).cast("long")


def tempered(tokens: dict, exponent: float) -> dict:
    """Normalised weights of sources with token counts; a source without tokens weighs nothing."""
    total = sum(tokens.values())
    powers = {k: (n / total) ** exponent if n else 0.0 for k, n in tokens.items()}
    norm = math.fsum(powers.values())
    return {k: p / norm for k, p in powers.items()} if norm else dict.fromkeys(tokens, 0.0)


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(low: float, high: float, meets: Callable[[float], bool]) -> tuple[float, float]:
    """An exponent that does not meet the goal and a higher one that does, as close as STEPS halvings bring them."""
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if meets(mid) else (mid, high)
    return low, high


def solve_mix(tokens: dict, *, target_entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None) -> Mix:
    """The exponent, bisected: with max_repeat, the least (most level) in [0, 1] for which no source is used over max_repeat times;
    with target_entropy (nats), the one, over 1 if need be, whose entropy is it. Raises if no exponent meets the goal: entropy
    lies between that of the largest sources alone and that of equal weights, and a budget over max_repeat times all tokens
    breaks the limit whatever the weights. Raises too if a source would be used over MAX_USES times, as a low entropy asks of the others
    when the rarest source is used whole: give a budget then.

    budget: tokens in all; by default so many that the source with the least weight against its share is used exactly
    once, so that no document is left out.
    """
    if (target_entropy is None) == (max_repeat is None):
        raise ValueError("give target_entropy or max_repeat")
    if max_repeat is not None and max_repeat < 1:
        raise ValueError("max_repeat must be at least 1")
    have = {k: n for k, n in tokens.items() if n}
    if not have:
        return Mix(1.0, 0, dict.fromkeys(tokens, 0))

    def total_of(w: dict) -> float:
        return budget if budget is not None else max(n / w[k] if w[k] else math.inf for k, n in have.items())

    def level_enough(x: float) -> bool:
        w = tempered(have, x)
        return max(w[k] * total_of(w) / n for k, n in have.items()) <= max_repeat * (1 + 1e-12)

    if max_repeat is not None:
        if not level_enough(1.0):
            raise ValueError(f"a budget of {budget} tokens uses some source over {max_repeat} times whatever the weights")
        x = 0.0 if level_enough(0.0) else _bisect(0.0, 1.0, level_enough)[1]
    else:
        top = 1.0
        while top < MAX_EXPONENT and entropy(tempered(have, top)) > target_entropy + CLOSE:
            top *= 2
        if entropy(tempered(have, 0.0)) < target_entropy - CLOSE or entropy(tempered(have, top)) > target_entropy + CLOSE:
            raise ValueError(f"no exponent gives an entropy of {target_entropy}")
        x = _bisect(0.0, top, lambda y: entropy(tempered(have, y)) < target_entropy)[0]
    w = tempered(tokens, x)
    total = total_of(w)
    if max(w[k] * total / n if total < math.inf else math.inf for k, n in have.items()) > MAX_USES:
        raise ValueError(f"some source would be used over {MAX_USES} times: give a smaller budget than {total:.6g} tokens")
    return Mix(x, math.floor(total + 0.5), {k: math.floor(w[k] * total + 0.5) for k in tokens})


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, kind, original struct<all columns>): the row's key and its source's name."""
    kind = F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit("-"))
    d = docs.select(kind.alias("kind"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("original"))
    return d.select(row_key(F.concat_ws("/", "kind", F.col("id").cast("string")), F.col("text")).alias("row"), "kind", "original")


def mix_sources(docs: DataFrame, *, target_entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Callable[[Column], Column] = word_count) -> DataFrame:
    """A row for each epoch's use of a document: row (its key), id, source, copies, n_tokens, epoch (from 0), block (its place
    among the epoch's blocks, from 0) and place (in the block, from 1).

    tokens counts a text's tokens: words, unless another function of the text is given. Rows equal in id, source and text are one unit, used together; copies tells their number and n_tokens
    is of one of them. A null source is a source of its own. A source without tokens has no budget: its documents are
    used once, in epoch 0, so empty texts are not lost. Null ids are kept, other columns are ignored. An empty table
    gives an empty result. The driver gets a row a source.
    """
    of = lambda c: F.col(f"original.`{c}`")
    d = _keyed(docs, id_col, text_col, source_col).select("row", "kind", of(id_col).alias("id"), of(source_col).alias("source"), tokens(of(text_col)).alias("n_tokens"))
    units = d.groupBy("row", "kind", "n_tokens").agg(F.min("id").alias("id"), F.first("source").alias("source"), F.count(F.lit(1)).alias("copies"))
    units = saved(units.withColumn("mass", F.col("n_tokens") * F.col("copies")), "mix-units")
    have = {r["kind"]: (r["n"], r["units"]) for r in units.groupBy("kind").agg(F.sum("mass").alias("n"), F.count(F.lit(1)).alias("units")).collect()}
    mix = solve_mix({k: n for k, (n, _) in have.items()}, target_entropy=target_entropy, max_repeat=max_repeat, budget=budget)
    rows = []
    for kind, (n, count) in have.items():
        epochs, rest = divmod(mix.budgets[kind], n) if n else (1, 0)
        rows.append((kind, int(epochs), int(rest), max(1, math.ceil(count / BLOCK_DOCS))))
    plan = docs.sparkSession.createDataFrame(rows, "kind string, epochs long, rest long, blocks long")
    uses = units.join(F.broadcast(plan), "kind").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    uses = uses.where((F.col("epoch") < F.col("epochs")) | (F.col("rest") > 0))
    uses = uses.withColumn("order", _hash(seed, F.col("epoch"), F.hex("row")))
    uses = uses.withColumn("cell", F.pmod(F.conv(F.substring("order", 1, 12), 16, 10).cast("long"), F.col("blocks")))
    cells = uses.groupBy("kind", "epoch", "cell", "epochs", "rest").agg(F.sum("mass").alias("cell_mass"))
    by_hash = Window.partitionBy("kind", "epoch").orderBy(_hash(seed, F.col("epoch"), F.col("kind"), F.col("cell")), "cell")
    earlier = F.coalesce(F.sum("cell_mass").over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"block": (F.row_number().over(by_hash) - 1).cast("long"), "before": earlier})
    # In a last, partial epoch only blocks that begin below the budget are of use, and of the last of them only a part.
    in_time = (F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("rest"))
    uses = uses.join(cells.where(in_time).select("kind", "epoch", "cell", "block", "before"), ["kind", "epoch", "cell"])
    inside = Window.partitionBy("kind", "epoch", "cell").orderBy("order", "row")
    ahead = F.coalesce(F.sum("mass").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    uses = uses.withColumns({"place": F.row_number().over(inside).cast("long"), "before": F.col("before") + ahead}).where(in_time)
    return uses.select("row", "id", "source", "copies", "n_tokens", "epoch", "block", "place")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as mix_sources() uses it, with the columns of docs."""
    uses = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    times = uses.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("times"))
    out = _keyed(docs, id_col, text_col, source_col).join(times, "row")
    return out.select("original", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("use")).select("original.*")
