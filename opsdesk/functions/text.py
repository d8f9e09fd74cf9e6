"""Text as Column expressions: width, blanks, masks, display width, case styles, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000"
FULL_DIGITS, HALF_DIGITS = "０１２３４５６７８９．", "0123456789."
#: Characters two columns wide on a terminal.
WIDE = r"[\u1100-\u115F\u2E80-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE4F\uFF00-\uFF60\uFFE0-\uFFE6]"
BLANK = r"(?U:\s)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_width(c: Column | str) -> Column:
    """STR1: full-width ASCII and the ideographic space as their half-width forms."""
    return F.translate(_col(c), FULL, HALF)


def half_width_digits(c: Column | str) -> Column:
    """STR2: full-width digits and point only."""
    return F.translate(_col(c), FULL_DIGITS, HALF_DIGITS)


def trim_u(c: Column | str) -> Column:
    """STR3: without blanks of any script at both ends (U+3000 and U+00A0 among them)."""
    return F.regexp_replace(_col(c), rf"^[\s\u00A0\u3000\uFEFF\p{{Z}}]+|[\s\u00A0\u3000\uFEFF\p{{Z}}]+$", "")


def blank(c: Column | str) -> Column:
    return F.coalesce(trim_u(c), F.lit("")) == ""


def mask(c: Column | str) -> Column:
    """STR7: the first and last four characters around at most twelve stars; stars alone up to eight characters."""
    c = _col(c)
    n = F.length(c)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 4), F.repeat(F.lit("*"), F.least(F.lit(12), n - 8)), F.right(c, F.lit(4))))


def display_width(c: Column | str) -> Column:
    """STR8: terminal columns, two for each wide character."""
    return F.length(_col(c)) + F.regexp_count(_col(c), F.lit(WIDE))


def csv_escape(c: Column | str, delimiter: str = ",") -> Column:
    """STR6: quoted only where a delimiter, quote or line end asks for it."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c.rlike(f'["\\r\\n{delimiter}]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def markdown_cell(c: Column | str) -> Column:
    """STR16: pipes escaped, line ends as <br>."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\|", r"\\|"), r"\r\n|\r|\n", "<br>")


def numericish(c: Column | str) -> Column:
    """STR17: a number with optional sign, currency mark, thousands commas and per cent sign."""
    return F.regexp_replace(trim_u(c), ",", "").rlike(r"^[-+]?[¥￥$]?\d+(\.\d+)?%?$")


def human_size(c: Column | str) -> Column:
    """STR18: bytes in steps of 1024, with no, one, one and two decimals."""
    b = _col(c).cast("double")
    step = lambda p, d, u: F.format_string(f"%.{d}f {u}", b / float(1024**p))
    return F.when(b < 1024, F.format_string("%d B", _col(c).cast("long"))).when(b < 1024**2, step(1, 1, "KB")).when(b < 1024**3, step(2, 1, "MB")).otherwise(step(3, 2, "GB"))


def words(c: Column | str) -> Column:
    """STR9: words of a name, cut at camel-case borders and at anything but letters and digits."""
    spaced = F.regexp_replace(F.regexp_replace(_col(c), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def case_style(c: Column | str, style: str) -> Column:
    """STR9: lower, upper, kebab, snake, camel or pascal."""
    c = _col(c)
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    if style == "lower":
        return F.lower(c)
    if style == "upper":
        return F.upper(c)
    if style in ("kebab", "snake"):
        return F.array_join(F.transform(words(c), F.lower), "-" if style == "kebab" else "_")
    pascal = F.array_join(F.transform(words(c), title), "")
    if style == "pascal":
        return pascal
    if style == "camel":
        return F.concat(F.lower(F.substring(pascal, 1, 1)), pascal.substr(F.lit(2), F.length(pascal)))
    raise ValueError(f"unknown style {style}")


def line_of(text: Column | str, offset: Column) -> Column:
    """STR19: the 1-based line of a 0-based character offset."""
    before = _col(text).substr(F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def context(text: Column | str, start: Column, size: Column, around: int = 12) -> Column:
    """STR20: the characters around a hit, line ends as blanks."""
    first = F.greatest(start - around, F.lit(0))
    return F.regexp_replace(_col(text).substr(first + 1, start + size + around - first), "\n", " ")


def singular(c: Column | str) -> Column:
    """STR14: English plural endings off."""
    c = _col(c)
    return F.when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y")).when(c.rlike("(ch|sh|ss|x|s)es$"), F.regexp_replace(c, "es$", "")).when(c.rlike("[^s]s$"), F.regexp_replace(c, "s$", "")).otherwise(c)


def identifier(c: Column | str) -> Column:
    """STR15: quoted unless it can stand bare."""
    c = _col(c)
    return F.when(c.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), c).otherwise(F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6))


def thousands(c: Column | str, digits: int = 2) -> Column:
    """STR5: a number for people: thousands commas, fixed digits, a dash for null. Half steps follow the double's decimal form."""
    return F.coalesce(F.format_number(_col(c).cast("double"), digits), F.lit("—"))


def natural_key(c: Column | str) -> Column:
    """SRT4: orders texts as people number them (file 2 before file 10), without regard to case."""
    padded = F.transform(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))
    return F.array_join(padded, "")


def chinese_order(c: Column | str) -> Column:
    """SRT2: a text with the collation that orders Chinese by pronunciation."""
    return F.collate(_col(c), "zh")


def table_cells(c: Column | str) -> Column:
    """STR22: the trimmed cells of a Markdown table row, cut at pipes that aren't escaped."""
    body = F.regexp_replace(F.trim(_col(c)), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(body, r"(?<!\\)\|"), lambda x: F.trim(x, F.lit(" \t\r")))
