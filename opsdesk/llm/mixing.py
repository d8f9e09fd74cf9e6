"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power ``a``, normalised. The exponent is bisected on [0, 1]: to the
target entropy of the weights, or, without one, to the smallest ``a`` under which no source is repeated more than
``max_repeats`` times. The token budget defaults to the least that reads every source once in whole.

A source of quota q and size t is read as blocks. Each block is a permutation of the source's documents, by a hash of
block number, id and text; all but the last are whole, and of the last those documents are taken whose tokens start before the
quota ends. The start of a document in its block comes from sums in three levels: groups of ranges of the hash, ranges, whose
number grows with the source, and rows inside a range, so that a source with a third of all rows is spread over many tasks.

No source is read more than ``max_repeats`` times. A target entropy or a budget may ask for more; mix() then warns with the
tokens that each source lacks and gives the mix without them; with ``strict`` it raises.

Only the table of sources (one row each) reaches the driver.

Defined results: a null source is a source of its own; null and blank texts have no tokens, start at the same place as
their successor and are taken with it; a source without tokens is read once; equal rows are documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import joined, positions
from .common import cut

_RANGE = 4_096  # rows of one hash range, about


def n_tokens(text: Column) -> Column:
    """Words between ASCII blanks."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \x09-\x0D]+|[ \x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \x09-\x0D]+"))).cast("long")


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised shares to the power of the exponent."""
    total = sum(tokens.values())
    p = {s: (t / total) ** exponent if t else 0.0 for s, t in tokens.items()} if total else dict.fromkeys(tokens, 0.0)
    norm = sum(p.values()) or 1.0
    return {s: x / norm for s, x in p.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def exponent(tokens: dict, *, target_entropy: float | None, max_repeats: float, budget: int | None) -> float:
    """Bisection: entropy falls and the repeats of the most repeated source fall as the exponent rises from 0 to 1."""

    def too_flat(a: float) -> bool:
        w = weights(tokens, a)
        if target_entropy is not None:
            return entropy(w) > target_entropy
        total = budget if budget is not None else least_budget(tokens, w)
        return any(w[s] * total > max_repeats * t for s, t in tokens.items() if t)

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def least_budget(tokens: dict, w: dict) -> int:
    """The least number of tokens by which every source is read once in whole."""
    return max((math.ceil(t / w[s] - 1e-9) for s, t in tokens.items() if t), default=0)


def shortfall(tokens: dict, w: dict, total: int, max_repeats: float) -> dict:
    """Tokens by which max_repeats keeps a source below its weight's part of the total (one is rounding)."""
    lacks = {s: round(w[s] * total) - int(max_repeats * t) for s, t in tokens.items() if t}
    return {s: n for s, n in lacks.items() if n > 1}


def mix(documents: DataFrame, *, target_entropy: float | None = None, max_repeats: float = 4.0, budget: int | None = None, strict: bool = False, max_sources: int = 100_000) -> DataFrame:
    """doc_id, source, n_tokens, block (from 1), start (tokens of the source's reading before the document, which orders it)
    and weight for each reading of a document."""
    # What orders a source's rows: id and text, and for rows without id, which may all be equal, their place in this table.
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    slim = cut(documents.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("key"), row.alias("row")))
    by = slim.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(by) > max_sources:
        raise ValueError(f"more than {max_sources} sources: their table goes to the driver and every task")
    tokens = {r.source: r.t for r in by}
    w = weights(tokens, exponent(tokens, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget))
    total = budget if budget is not None else least_budget(tokens, w)
    lacks = shortfall(tokens, w, total, max_repeats)
    if lacks:
        short = f"max_repeats={max_repeats} leaves {len(lacks)} sources short of their weights, by {sum(lacks.values())} tokens: {dict(sorted(lacks.items(), key=str)[:20])}"
        if strict:
            raise ValueError(short)
        warnings.warn(short, stacklevel=2)
    plan = []
    for r in by:
        quota = min(round(w[r.source] * total), int(max_repeats * r.t)) if r.t else 0
        full, rest = divmod(quota, r.t) if r.t else (1, 0)
        plan.append((r.source, w[r.source], r.t, full, rest, max(1, -(-r.n // _RANGE))))
    # One row for each source, max_sources at most: a broadcast of a few MB.
    plan = documents.sparkSession.createDataFrame(plan, "s string, weight double, t long, full long, rest long, ranges long")
    each = slim.join(F.broadcast(plan), F.col("s").eqNullSafe(F.col("source").cast("string"))).drop("s")
    n_blocks = F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)
    each = each.where(n_blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), n_blocks)))
    each = each.withColumn("h", F.xxhash64("doc_id", "block", "key", "row")).withColumn("r", F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("ranges")).cast("long"))
    inside = Window.partitionBy("source", "block", "r").orderBy("h", "doc_id", "key", "n_tokens", "row").rowsBetween(Window.unboundedPreceding, -1)
    of_group = Window.partitionBy("source", "block", "g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    of_block = Window.partitionBy("source", "block").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("source", "block", "r").agg(F.sum("n_tokens").alias("x")).withColumn("g", F.floor(F.col("r") / _RANGE).cast("long"))
    groups = sums.groupBy("source", "block", "g").agg(F.sum("x").alias("x"))
    groups = groups.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("g").alias("o"), F.coalesce(F.sum("x").over(of_block), F.lit(0)).alias("groups"))
    sums = sums.withColumn("ranges", F.coalesce(F.sum("x").over(of_group), F.lit(0)))
    sums = sums.join(groups, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block")) & (F.col("o") == F.col("g"))).drop("s", "b")
    before = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("r").alias("q"), (F.col("groups") + F.col("ranges")).alias("before"))
    placed = each.withColumn("in_range", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block")) & (F.col("q") == F.col("r")))
    at = F.col("before") + F.col("in_range")
    return placed.where((F.col("block") <= F.col("full")) | (at < F.col("rest"))).select("doc_id", "source", "n_tokens", "block", ((F.col("block") - 1) * F.col("t") + at).alias("start"), "weight")


def realise(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The texts in mixed proportions: mixed with the other columns of documents (doc_id, source, text and more). Rows of one
    doc_id, source and size, as rows without id may be, are paired one to one within a block, so each reading has a text."""
    other = [c for c in documents.columns if c not in mixed.columns]
    keys = ["doc_id", "source", "n_tokens"]
    texts = positions(documents.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), *other), keys, [F.xxhash64("text"), "text"], "_copy")
    readings = positions(mixed, [*keys, "block"], ["start"], "_copy")
    return joined(readings, texts, [*keys, "_copy"]).drop("_copy")
