"""Differences of two tables by key (JN1-JN5, SET1, SET2, WIN1): one full outer join of the sides' first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import trim_u


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN1: as an aggregate that folds before the exchange, so that a key with many rows costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order)) if order else F.first(F.struct(*rest))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*df.columns)


def same_cell(a: Column, b: Column, *, exact: bool = False) -> Column:
    """JN5: equal text, or equal numbers however they are written unless exact is asked for."""
    a, b = (F.coalesce(x.cast("string"), F.lit("")) for x in (a, b))
    text = trim_u(a) == trim_u(b)
    return text if exact else text | F.coalesce(parse_number(a, "diff") == parse_number(b, "diff"), F.lit(False))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], *, line: str | None = None, exact: bool = False) -> DataFrame:
    """Keys, status (added, removed, changed, unchanged) and changes, the altered cells as (column_name, old, new)."""
    common = [c for c in a.columns if c in b.columns and c not in keys and c != line]
    order = [line] if line else common

    def side(df: DataFrame, name: str) -> DataFrame:
        one = first_per_key(df, keys, order)
        return one.select(*[trim_u(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) if dict(df.dtypes)[k] == "string" else F.col(k) for k in keys], F.struct(F.lit(1).alias("_here"), *common).alias(name))

    both = side(a, "_a").join(side(b, "_b"), keys, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_a.{c}").cast("string").alias("old"), F.col(f"_b.{c}").cast("string").alias("new"), same_cell(F.col(f"_a.{c}"), F.col(f"_b.{c}"), exact=exact).alias("same")) for c in common])
    changes = F.transform(F.filter(cells, lambda x: ~x.same), lambda x: F.struct(x.column_name.alias("column_name"), x.old.alias("old"), x.new.alias("new")))
    here = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    both = both.withColumn("changes", F.when(here, changes))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size("changes") > 0, "changed").otherwise("unchanged")
    return both.select(*keys, status.alias("status"), "changes")


def changed_cells(diff: DataFrame, keys: list[str]) -> DataFrame:
    """JN4: one row for each altered cell."""
    return diff.where("status = 'changed'").select(*keys, F.explode("changes").alias("x")).select(*keys, "x.*")


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JN2, SET1: rows of a whose key b lacks."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET2."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")
