"""Cleaning of cells and rows (PRJ3-PRJ8): each step a projection, so all of it is one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..functions.text import half_width, trim_u


def clean_cells(df: DataFrame, *, width: list[str] = (), dates: list[str] = (), numbers: list[str] = (), compact_dates: bool = False) -> DataFrame:
    """Text columns trimmed; then width folded, dates as ISO text and numbers without decoration where they can be read."""
    out = {}
    for c, kind in df.dtypes:
        if kind != "string":
            continue
        x = trim_u(F.col(c))
        if c in width:
            x = trim_u(half_width(x))
        if c in dates:
            x = F.coalesce(parse_date(x, compact=compact_dates).cast("string"), x)
        if c in numbers:
            x = F.coalesce(parse_number(x, "csv"), x)
        out[c] = x
    return df.withColumns(out)


def change_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """column_name, changed: cells that cleaning altered."""
    names = [c for c, kind in before.dtypes if kind == "string" and c != key]
    both = before.select(key, F.struct(*names).alias("b")).join(after.select(key, F.struct(*names).alias("a")), key)
    counts = both.agg(*[F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("changed")) for c in names])).alias("x")).select("x.*")


def drop_blank_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """PRJ4: rows whose cells are all blank go."""
    return rows.where(F.exists(cells, lambda x: F.coalesce(trim_u(x), F.lit("")) != ""))


def even_rows(rows: DataFrame, cells: str = "cells", line: str = "line") -> DataFrame:
    """PRJ5: every row padded or cut to the most frequent width; ragged marks those that differed."""
    widths = rows.groupBy(F.size(cells).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first"))
    usual = widths.agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("w"))  # one row
    filled = F.expr(f"transform(sequence(1, w), i -> coalesce(try_element_at({cells}, i), ''))")
    return rows.join(F.broadcast(usual)).select(*[c for c in rows.columns if c != cells], F.when(F.col("w") > 0, filled).otherwise(F.array()).alias(cells), (F.size(F.col(cells)) != F.col("w")).alias("ragged"))


def flip(df: DataFrame, cents: str = "cents") -> DataFrame:
    """PRJ6: the other side's sign."""
    return df.withColumn(cents, -F.col(cents))
