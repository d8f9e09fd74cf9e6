"""Column profiles and data-quality findings (AGG16-AGG18, PRJ8, RUL1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import invalid_date, parse_date
from ..functions.numbers import parse_number
from ..functions.text import trim_u
from .aggregate import exact_percentiles


def _type(n: Column, dates: Column, shaped: Column, ints: Column, decimals: Column, numbers: Column) -> Column:
    return (
        F.when(n == 0, "empty").when(dates == n, "date").when(shaped == n, "date_with_errors").when(ints == n, "integer").when(decimals == n, "decimal")
        .when((numbers > 0) & (numbers < n), "mixed").when(numbers == n, "number").otherwise("string")
    )


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("raw")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").withColumn("v", trim_u("raw")).withColumn("number", parse_number("v", "quality"))


def _shown(cells: DataFrame, n: int) -> DataFrame:
    """column_name, shown: the n smallest values of each column, ranked in part before the shuffle."""
    w = Window.partitionBy("column_name").orderBy("v")
    return cells.select("column_name", "v").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy("column_name").agg(F.sort_array(F.collect_list("v")).alias("shown"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: counts, null rate, inferred type, padding, invalid dates, number range and average,
    IQR outliers and up to three sample values (the smallest, since rows have no order)."""
    cells = _long(df, columns or df.columns)
    filled = F.col("v") != ""
    stats = cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(filled).alias("non_blank"), F.count_if(~filled).alias("blank"), F.count_distinct(F.when(filled, F.col("v"))).alias("unique_values"),
        _type(F.count_if(filled), F.count_if(parse_date("v").isNotNull()), F.count_if(filled & (parse_date("v").isNotNull() | invalid_date("v"))), F.count_if(F.col("v").rlike(r"^-?\d+$")), F.count_if(F.col("v").rlike(r"^-?\d+(\.\d+)?$")), F.count("number")).alias("type"),
        F.coalesce(F.bool_or((F.col("raw") != "") & (F.col("raw") != F.col("v"))), F.lit(False)).alias("padded"), F.count_if(invalid_date("raw")).alias("invalid_dates"),
        F.min("number").alias("min_value"), F.max("number").alias("max_value"), F.avg("number").alias("avg_value"), F.count("number").alias("numbers"),
    )
    stats = stats.join(exact_percentiles(cells, ["column_name"], "number", {"_q1": 0.25, "_q3": 0.75}), "column_name", "left")
    # One row for each column of the table: bounded by its width.
    spread = F.col("_q3") - F.col("_q1")
    bounds = stats.where((F.col("numbers") >= 4) & (spread > 0)).select("column_name", (F.col("_q1") - 1.5 * spread).alias("low"), (F.col("_q3") + 1.5 * spread).alias("high"))
    beyond = cells.join(F.broadcast(bounds), "column_name").groupBy("column_name").agg(F.count_if((F.col("number") < F.col("low")) | (F.col("number") > F.col("high"))).alias("outliers"))
    out = stats.join(beyond, "column_name", "left").join(_shown(cells.where(filled), 3).withColumnRenamed("shown", "samples"), "column_name", "left")
    return out.withColumns({"outliers": F.coalesce("outliers", F.lit(0)), "samples": F.coalesce("samples", F.array().cast("array<string>")), "null_rate": F.coalesce(F.col("blank") / F.col("n_rows"), F.lit(0.0))}).drop("_q1", "_q3")


def outliers(df: DataFrame, value: str) -> DataFrame:
    """AGG18: rows beyond 1.5 interquartile ranges; none below four values or without spread."""
    q = df.agg(F.count(value).alias("n")).join(exact_percentiles(df, [], value, {"a": 0.25, "b": 0.75}))  # one row
    q = q.where("n >= 4 and b > a").select((F.col("a") - 1.5 * (F.col("b") - F.col("a"))).alias("_low"), (F.col("b") + 1.5 * (F.col("b") - F.col("a"))).alias("_high"))
    return df.join(F.broadcast(q), (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))).drop("_low", "_high")  # one row of bounds


def findings(df: DataFrame, *, null_rate: float = 0.1, enums: dict[str, list[str]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """level, code, column_name, n, shown (of Q005 up to five of the values, the smallest). Q001 blanks over the rate, Q002 all blank, Q003 equal rows, Q005 values outside a set,
    Q006 padding, Q007 impossible dates, Q008 mixed types, W101 one value, W102 all different, W104 outliers."""
    columns = columns or df.columns
    p = profile(df, columns)
    rule = lambda when, level, code, n: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("long").alias("n")))
    c = F.col
    rules = F.array(
        rule((c("non_blank") == 0) & (c("n_rows") > 0), "E", "Q002", c("blank")), rule((c("non_blank") > 0) & (c("blank") / c("n_rows") > null_rate), "E", "Q001", c("blank")),
        rule(c("type") == "mixed", "E", "Q008", c("numbers")), rule(c("invalid_dates") > 0, "E", "Q007", c("invalid_dates")), rule(c("padded"), "E", "Q006", F.lit(1)),
        rule((c("unique_values") == 1) & (c("non_blank") > 1), "W", "W101", c("non_blank")), rule((c("unique_values") == c("non_blank")) & (c("non_blank") > 1) & c("type").isin("integer", "string"), "W", "W102", c("unique_values")),
        rule(c("outliers") > 0, "W", "W104", c("outliers")),
    )
    out = p.select("column_name", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("f")).select("f.level", "f.code", "column_name", "f.n", F.lit(None).cast("array<string>").alias("shown"))
    equal = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    parts = [out, equal.select(F.lit("E").alias("level"), F.lit("Q003").alias("code"), F.lit("*").alias("column_name"), "n", F.lit(None).cast("array<string>").alias("shown"))]
    for name, allowed in (enums or {}).items():
        v = trim_u(F.col(name).cast("string"))
        bad = df.where((v != "") & ~v.isin(allowed)).select(F.lit(name).alias("column_name"), v.alias("v"))
        bad = bad.groupBy("column_name").agg(F.count_distinct("v").alias("n")).join(F.broadcast(_shown(bad, 5)), "column_name")  # one row
        parts.append(bad.select(F.lit("E").alias("level"), F.lit("Q005").alias("code"), "column_name", "n", "shown"))
    return reduce(DataFrame.unionByName, parts)
