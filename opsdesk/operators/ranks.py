"""Positions in an order, for keys of any size: a key's rows are never in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def joined(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """a with the columns of b where both agree in these, missing values with each other. Both sides are dealt by key."""
    right = b.select(*[F.col(c).alias(f"_right_{c}") for c in columns], *[c for c in b.columns if c not in columns]).hint("merge")
    agree = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in columns])
    return a.join(right, agree, how).drop(*[f"_right_{c}" for c in columns])


def positions(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "nth") -> DataFrame:
    """df with each row's place (from 1) among the rows of its keys. Rows are dealt by ranges of keys and order, so that a
    common key lies in many ranges; places within a range are counted there, and what precedes a range is the sum of the
    counts before it, one row for each key and range. ``order`` should tell any two rows of a key apart."""
    ranges = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = ranges.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    counts = ranges.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)) if keys else F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return joined(inside, counts, [*keys, "_range"]).select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))
