"""Numbers and money written by people, as Column expressions.

MTH1 has six profiles, which differ in what they accept:
agg: full-width digits, one leading currency mark or plus, half- or full-width parentheses for negatives;
csv: every full-width form, currency marks and blanks anywhere, result as text with its zeros;
diff: full-width digits and currency marks, no parentheses; cents: as agg, in whole cents by the binary double;
invoice: a currency mark, the first parenthesis as a minus; amount: RMB, CNY and the yen signs, cents by the third decimal.
Blank, unfinished and scientific notation is null everywhere: nothing unreadable becomes 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_width, half_width_digits, trim_u


def _plain(s: Column) -> Column:
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), s)


def parse_number(c: Column | str, profile: str = "agg") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    s = trim_u(c)
    if profile in ("agg", "cents"):
        s = F.regexp_replace(half_width_digits(s), "[,，\\s]", "")
        wrapped = s.rlike(r"^[(（].*[)）]$")
        s = F.when(wrapped, F.concat(F.lit("-"), s.substr(F.lit(2), F.length(s) - 2))).otherwise(s)
        s = F.regexp_replace(F.regexp_replace(s, r"^(-*)[¥￥$+]", "$1"), r"^--", "-")
        sign = F.when(s.startswith("-"), -1.0).otherwise(1.0)
        value = _plain(F.regexp_replace(s, "^-", "")).cast("double")
        if profile == "agg":
            return sign * value
        return (sign * F.floor(value * 100 + 0.5)).cast("long")
    if profile == "csv":
        wrapped = s.rlike(r"^\(.*\)$")
        inner = half_width(F.when(wrapped, s.substr(F.lit(2), F.length(s) - 2)).otherwise(s))
        inner = F.regexp_replace(inner, r"[,¥￥$\s]", "")
        minus = inner.startswith("-")
        digits = _plain(F.regexp_replace(inner, "^[-+]", ""))
        return F.when(digits.isNotNull(), F.concat(F.when(minus != wrapped, "-").otherwise(""), digits))
    if profile in ("diff", "quality"):
        s = F.regexp_replace(half_width_digits(s), r"[,，¥￥$\s]", "")
        return F.when(s.startswith("-"), -1.0).otherwise(1.0) * _plain(F.regexp_replace(s, "^-", "")).cast("double")
    if profile == "invoice":
        s = F.regexp_replace(F.translate(s, "０１２３４５６７８９", "0123456789"), r"[,，¥￥$\s]", "")
        s = F.regexp_replace(F.regexp_replace(s, r"^[(（]", "-"), r"[)）]$", "")
        return F.when(s.startswith("-"), -1.0).otherwise(1.0) * _plain(F.regexp_replace(s, "^-", "")).cast("double")
    if profile == "amount":
        s = F.regexp_replace(F.translate(half_width_digits(s), "。", "."), r"(?i)RMB|CNY|[¥￥元,，\s]", "")
        minus, s = s.startswith("-"), F.regexp_replace(s, "^-", "")
        ok = _plain(s)
        whole, part = F.regexp_extract(ok, r"^(\d+)", 1), F.rpad(F.regexp_extract(ok, r"\.(\d+)$", 1), 3, "0")
        cents = whole.try_cast("long") * 100 + part.substr(1, 2).try_cast("long") + F.when(part.substr(3, 1) >= "5", 1).otherwise(0)
        return F.when(cents < 10**14, F.when(minus, -cents).otherwise(cents))
    raise ValueError(f"unknown profile {profile}")


def cents_text(c: Column | str) -> Column:
    """MTH2: cents as a decimal number of two places."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def near(a: Column, b: Column, tolerance: float) -> Column:
    """MTH8."""
    return F.abs(a - b) <= tolerance + 1e-9


def tax_rate(c: Column | str) -> Column:
    """MTH9: 13%, 13 and 0.13 as 0.13."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(trim_u(c), "%$", "")
    value = parse_number(s, "invoice")
    return F.when(trim_u(c).endswith("%") | (value > 1), value / 100).otherwise(value)


#: Digits, places and sections of capital numerals.
CAPITALS = "零壹贰叁肆伍陆柒捌玖"
PLACES = ("仟", "佰", "拾", "")
SECTIONS = ("万亿", "亿", "万", "")


def capital_amount(cents: Column | str) -> Column:
    """MTH3: cents as a capital numeral: sections of four digits, inner zeros as one, 整 without 角 and 分. All in whole numbers: a
    double has no room for every amount over 2^53 cents."""
    cents = F.col(cents) if isinstance(cents, str) else cents
    a = F.abs(cents).cast("long")
    div = lambda x, y: F.call_function("div", x, F.lit(y))
    yuan, jiao, fen = div(a, 100), F.pmod(div(a, 10), F.lit(10)).cast("int"), F.pmod(a, F.lit(10)).cast("int")
    digit = lambda d: F.substring(F.lit(CAPITALS), 1, 1) if d is None else F.lit(CAPITALS).substr(d + 1, F.lit(1))
    digits = F.lpad(yuan.cast("string"), 16, "0")
    parts = []
    for s, name in enumerate(SECTIONS):
        inside = [F.when(F.substring(digits, 4 * s + k + 1, 1) == "0", "零").otherwise(F.concat(digit(F.substring(digits, 4 * s + k + 1, 1).cast("int")), F.lit(PLACES[k]))) for k in range(4)]
        parts.append(F.when(F.substring(digits, 4 * s + 1, 4) == "0000", "零").otherwise(F.concat(F.regexp_replace(F.concat(*inside), "零+$", ""), F.lit(name))))
    text = F.regexp_replace(F.regexp_replace(F.concat(*parts), "零+", "零"), "^零|零$", "")
    whole = F.when(yuan == 0, F.lit("零元")).otherwise(F.concat(text, F.lit("元")))
    small = F.when((jiao == 0) & (fen == 0), "整").when(fen == 0, F.concat(digit(jiao), F.lit("角"))).when(jiao == 0, F.concat(F.lit("零"), digit(fen), F.lit("分"))).otherwise(F.concat(digit(jiao), F.lit("角"), digit(fen), F.lit("分")))
    return F.when((yuan == 0) & ((jiao > 0) | (fen > 0)), F.concat(F.when(cents < 0, "负").otherwise(""), F.lit("零元"), small)).otherwise(F.concat(F.when(cents < 0, "负").otherwise(""), whole, small))
