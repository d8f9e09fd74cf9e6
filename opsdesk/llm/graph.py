"""Connected components as joins: alternating large-star and small-star steps, logarithmic in the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, wide


def _star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (u, v) and the smallest of u and its v for each u. The minima are written, so that the join that follows
    exchanges both sides and a hub's rows can be split."""
    return pairs, cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _seen(df: DataFrame) -> tuple[DataFrame, tuple]:
    """df, written, with its number of rows and a sum over them that are counted while it is written."""
    counted = Observation()
    out = cut(df.observe(counted, F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")).alias("s")))
    return out, tuple(counted.get.values())


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b, in either order, with repeats. Returns node and root (the smallest node reachable) for every
    node that isn't its own root."""
    e, seen = _seen(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while seen[0]:
        pairs, m = _star(e.union(e.select("v", "u")))
        large = pairs.where("v > u").join(wide(m), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pairs, m = _star(cut(large))
        e, now = _seen(pairs.join(wide(m), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m).distinct())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
