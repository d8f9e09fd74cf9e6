"""Grouped aggregation of untyped tables (AGG1-AGG15, AGG24, SRT1-SRT3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import blank, trim_u
from .columns import resolve


def _number(df: DataFrame, name: str) -> Column:
    return parse_number(name) if dict(df.dtypes)[name] == "string" else F.col(name)


PERCENTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95}


def exact_percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], *, buckets: int = 64) -> DataFrame:
    """Keys and one column for each named percentile (linear interpolation, nulls left out) of a numeric column.

    Exact without holding a group in a task: equal values fold first, a sketch cuts each group into buckets of about equal size,
    their counts tell which buckets hold the wanted ranks, and only those are put in order."""
    keys_ = keys or ["_all"]
    x = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_x")).where("_x is not null")
    same = lambda l, r, names: reduce(lambda p, q: p & q, [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in names])  # noqa: E731, E741
    values = x.groupBy(*keys_, "_x").agg(F.count(F.lit(1)).alias("_n"))
    edges = values.groupBy(*keys_).agg(F.percentile_approx("_x", [k / buckets for k in range(1, buckets)], F.lit(100 * buckets)).alias("_e"), F.sum("_n").alias("_total"))
    placed = values.alias("v").join(edges.alias("e"), same("v", "e", keys_)).select("v.*", "_total", F.size(F.filter("_e", lambda e: e < F.col("_x"))).alias("_b"))
    sums = placed.groupBy(*keys_, "_b").agg(F.sum("_n").alias("_s"), F.first("_total").alias("_total"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*keys_).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
    rank = {name: (F.col("_total") - 1) * p for name, p in at.items()}
    inside = lambda r, a, b: (r >= a) & (r < b)
    ends = [r for x in rank.values() for r in (F.floor(x), F.ceil(x))]
    wanted = sums.withColumn("_before", before).where(reduce(lambda p, q: p | q, [inside(r, F.col("_before"), F.col("_before") + F.col("_s")) for r in ends])).select(*keys_, "_b", "_before")
    rows = placed.alias("v").join(wanted.alias("w"), same("v", "w", [*keys_, "_b"])).select("v.*", "_before")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys_, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_upto", upto)
    value_at = lambda r: F.max(F.when(inside(r, F.col("_upto") - F.col("_n"), F.col("_upto")), F.col("_x")))
    share = {name: F.max(r - F.floor(r)) for name, r in rank.items()}
    out = [F.when(share[n] == 0, value_at(F.floor(r))).otherwise((1 - share[n]) * value_at(F.floor(r)) + share[n] * value_at(F.ceil(r))).alias(n) for n, r in rank.items()]
    return rows.groupBy(*keys_).agg(*out).select(*keys, *at)


def metric(df: DataFrame, kind: str, ref: str | int) -> Column:
    """One of sum, avg, min, max, distinct, blank over a column; unreadable cells count for blank only."""
    name = resolve(df, ref)
    x = _number(df, name)
    out = {
        "sum": lambda: F.sum(x),
        "avg": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "distinct": lambda: F.count_distinct(F.coalesce(F.col(name).cast("string"), F.lit(""))),
        "blank": lambda: F.count(F.lit(1)) - F.count(x),
    }[kind]()
    return out.alias(f"{kind}_{name}")


def aggregate(df: DataFrame, by: list[str | int], metrics: list[tuple[str, str | int]]) -> DataFrame:
    """Keys (trimmed, missing as empty text), row_count and one column for each metric, percentiles (median, p90, p95) among
    them; no key gives one row."""
    keys = [resolve(df, k) for k in by]
    cols = [trim_u(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) if dict(df.dtypes)[k] == "string" else F.col(k) for k in keys]
    out = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count"), *[metric(df, *m) for m in metrics if m[0] not in PERCENTILES])
    ranked: dict[str, dict[str, float]] = {}
    for kind, ref in metrics:
        if kind in PERCENTILES:
            name = resolve(df, ref)
            ranked.setdefault(name, {})[f"{kind}_{name}"] = PERCENTILES[kind]
    for name, at in ranked.items():
        p = exact_percentiles(df.select(*cols, _number(df, name).alias("_value")), keys, "_value", at)
        both = reduce(lambda a, b: a & b, [out[k].eqNullSafe(p[k]) for k in keys], F.lit(True))
        out = out.join(p, both, "left").select(*[out[c] for c in out.columns], *at)
    return out.select(*keys, "row_count", *[f"{kind}_{resolve(df, ref)}" for kind, ref in metrics])


def sort_groups(grouped: DataFrame, spec: str | None = None, top: int | None = None) -> DataFrame:
    """spec: "column" or "column:asc"; by row_count without one. Descending, nulls last, ties by the columns in order."""
    name, _, way = (spec or "row_count").partition(":")
    name = resolve(grouped, name) if name in grouped.columns or name.isdigit() else "row_count"
    first = F.asc_nulls_last(name) if way == "asc" else F.desc_nulls_last(name)
    out = grouped.orderBy(first, *[c for c in grouped.columns if c != name])
    return out if top is None else out.limit(top)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """AGG10: one row for each column."""
    columns = columns or df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), trim_u(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("text"), _number(df, c).cast("double").alias("x")) for c in columns])).alias("cell")
    rows = df.select(cells).select("cell.*")
    filled = F.count_if(F.col("text") != "")
    out = rows.groupBy("column_name").agg(
        filled.alias("non_blank"), F.count_if(F.col("text") == "").alias("blank"), F.count_distinct(F.nullif("text", F.lit(""))).alias("distinct_values"),
        F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.avg("x").alias("avg_value"), ((filled > 0) & (filled == F.count("x"))).alias("numeric"),
    )
    p = exact_percentiles(rows, ["column_name"], "x", {"median_value": 0.5, "p90_value": 0.9})
    return out.join(p, "column_name", "left").select("column_name", "non_blank", "blank", "distinct_values", "min_value", "max_value", "avg_value", "median_value", "p90_value", "numeric")


def subtotals(df: DataFrame, key: str, cents: str, missing: str = "（未填）") -> DataFrame:
    """AGG11: readable amounts by key, largest first."""
    k = F.when(blank(F.col(key).cast("string")), F.lit(missing)).otherwise(F.col(key).cast("string"))
    return df.where(F.col(cents).isNotNull()).groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents")).orderBy(F.desc("cents"), "key")


def duplicate_keys(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """AGG14: keys of several rows, with their number and their first and last line."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first_line"), F.max(line).alias("last_line")).where("n > 1")


def duplicate_lines(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """AGG14: every line of the keys of several rows: keys, n, line. Rows instead of a list, so that no key's lines have to fit in
    a task; a null is a key like any other."""
    several = duplicate_keys(df, keys, line).select(*[F.col(k).alias(f"_{k}") for k in keys], "n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.select(*keys, line).join(several, same).select(*keys, "n", line)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """AGG15: one row: repeats beyond the first occurrence, and groups of equal rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"), F.count_if(F.col("_n") > 1).alias("groups"))


def first_mode(df: DataFrame, column: str, line: str) -> DataFrame:
    """AGG24, PRJ5: the most frequent value, of equals the one seen first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first_line")).orderBy(F.desc("n"), "first_line").limit(1)
