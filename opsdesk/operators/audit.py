"""Rule packs for expense claims and invoices (RUL2, RUL3, AGG12, AGG19, JN12, PRJ7): findings as (line, level, code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import credit_code, old_tax_number
from ..functions.numbers import near
from ..functions.text import blank
from ..shared import sized

#: The tax rates in use.
KNOWN_RATES = (0.0, 0.01, 0.015, 0.03, 0.05, 0.06, 0.09, 0.10, 0.11, 0.13, 0.16, 0.17)


def _rules(df: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for when, level, code in rules]), lambda x: x.isNotNull())
    return df.select("line", F.explode(found).alias("x")).select("line", "x.level", "x.code")


def expense_findings(claims: DataFrame, *, as_of: str, limits: DataFrame | None = None, max_age_days: int = 90, require_approver: bool = False, required: tuple[str, ...] = ("date_text", "person", "type", "amount_text")) -> DataFrame:
    """claims: line, date_text, d, person, type, amount_text, cents, invoice_no, approver. limits: type, cents.
    E401 required blank, E402 unreadable or zero, W506 negative, W507 invoice number not of 8 digits, W503 too old,
    E406 future or unreadable date, W502 no approver, E403 repeated invoice number, W504 equal claims, W501 over the limit."""
    c, today = F.col, F.lit(as_of).cast("date")
    rules = [(blank(c(k)), "E", "E401") for k in required if k in claims.columns]
    rules += [
        (c("cents").isNull() & ~blank(c("amount_text")), "E", "E402"), (c("cents") == 0, "E", "E402"), (c("cents") < 0, "W", "W506"),
        (c("invoice_no").rlike(r"^\d+$") & ~c("invoice_no").rlike(r"^\d{8}$"), "W", "W507"), (F.datediff(today, c("d")) > max_age_days, "W", "W503"),
        ((c("d") > today) | (c("d").isNull() & ~blank(c("date_text"))), "E", "E406"),
    ]
    if require_approver:
        rules.append((blank(c("approver")), "W", "W502"))
    first = lambda df, keys, level, code: df.groupBy(*keys).agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n")).where("n > 1").select("line", F.lit(level).alias("level"), F.lit(code).alias("code"))
    parts = [
        _rules(claims, rules),
        first(claims.where(~blank(c("invoice_no"))), ["invoice_no"], "E", "E403"),
        first(claims.where(~blank(c("person")) & c("d").isNotNull() & c("cents").isNotNull()), ["person", "d", "cents", "type"], "W", "W504"),
    ]
    if limits is not None:
        norm = lambda x: F.lower(F.regexp_replace(x, r"\s", ""))
        most = limits.select(norm(F.col("type")).alias("_type"), F.col("cents").alias("_limit"))
        over = claims.withColumn("_type", norm(c("type"))).join(sized(most, 100_000), "_type").where("cents > _limit")
        parts.append(over.select("line", F.lit("W").alias("level"), F.lit("W501").alias("code")))
    return reduce(DataFrame.unionByName, parts)


def total_mismatch(claims: DataFrame, declared_cents: int) -> DataFrame:
    """AGG12: one row with code E405 if the claims don't add up to what is declared."""
    total = claims.agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    return total.where(F.col("cents") != declared_cents).select(F.lit(0).cast("long").alias("line"), F.lit("E").alias("level"), F.lit("E405").alias("code"))


def invoice_findings(invoices: DataFrame, *, as_of: str, tolerance: float = 0.02) -> DataFrame:
    """invoices: line, code, no, amount, tax, total, rate, date_text, d, tax_no.
    E101 code, E102 number, E105 unknown rate, E103 tax, E104 total, E106 date, W302 older than a year, E107 tax number,
    W303 its length, W301 negative, E201 repeated code and number."""
    c, today = F.col, F.lit(as_of).cast("date")
    implied = F.when((c("amount") != 0) & (F.abs(c("tax") / F.nullif(c("amount"), F.lit(0.0))) < 1), c("tax") / F.nullif(c("amount"), F.lit(0.0)))
    x = invoices.withColumn("_rate", F.coalesce(c("rate"), implied))
    known = reduce(lambda p, q: p | q, [near(c("_rate"), F.lit(r), 0.0001) for r in KNOWN_RATES])
    cents = lambda e: F.floor(e * 100 + 0.5) / 100
    shape, old = credit_code("tax_no"), old_tax_number("tax_no")
    rules = [
        (~blank(c("code")) & ~c("code").rlike(r"^(\d{10}|\d{12})$"), "E", "E101"), (~blank(c("no")) & ~c("no").rlike(r"^\d{8}$"), "E", "E102"), (~known, "E", "E105"),
        (~near(cents(c("amount") * c("_rate")), c("tax"), tolerance), "E", "E103"), (~near(cents(c("amount") + c("tax")), c("total"), 0.01), "E", "E104"),
        ((c("d").isNull() & ~blank(c("date_text"))) | (c("d") > today), "E", "E106"), (F.datediff(today, c("d")) > 365, "W", "W302"),
        (~blank(c("tax_no")) & ((shape == F.lit(False)) | (shape.isNull() & (old == F.lit(False)))), "E", "E107"), (~blank(c("tax_no")) & shape.isNull() & old.isNull(), "W", "W303"),
        ((c("amount") < 0) | (c("total") < 0), "W", "W301"),
    ]
    twice = invoices.where(~blank(c("no"))).groupBy("code", "no").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rules(x, [(F.coalesce(w, F.lit(False)), lv, code) for w, lv, code in rules]).unionByName(twice.select("line", F.lit("E").alias("level"), F.lit("E201").alias("code")))


def tally(findings: DataFrame) -> DataFrame:
    """AGG19."""
    return findings.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


def passed(findings: DataFrame) -> DataFrame:
    """The gate: one row, true if no finding has level E."""
    return findings.agg((F.count_if(F.col("level") == "E") == 0).alias("passed"))
