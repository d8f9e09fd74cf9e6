"""Dates, durations and subtitle times as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_u

_SHAPE = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$"


def parse_date(c: Column | str, *, compact: bool = False) -> Column:
    """DT1: a real calendar day or null. compact also accepts eight digits in a row."""
    s = trim_u(c)
    part = lambda k: F.regexp_extract(s, _SHAPE, k)
    text = F.when(s.rlike(_SHAPE), F.concat_ws("-", part(1), part(2), part(3)))
    if compact:
        text = F.when(s.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise(text)
    return F.try_to_date(text, "yyyy-M-d")


def looks_like_date(c: Column | str) -> Column:
    """DT2."""
    return trim_u(c).rlike(_SHAPE)


def invalid_date(c: Column | str) -> Column:
    """DT2: shaped like a date, but no day of the calendar."""
    return looks_like_date(c) & parse_date(c).isNull()


def day_gap(a: Column, b: Column) -> Column:
    """DT3: 0 if either is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(0))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """DT13: minutes from one HH:MM to another, over midnight if it is earlier."""
    at = lambda c: F.split_part(F.col(c) if isinstance(c, str) else c, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(F.col(c) if isinstance(c, str) else c, F.lit(":"), F.lit(2)).cast("int")
    return F.pmod(at(end) - at(start), F.lit(1440))


def subtitle_ms(c: Column | str) -> Column:
    """DT15: HH:MM:SS,mmm, [HH:]MM:SS.mmm and H:MM:SS.cc as milliseconds; a short fraction is filled up."""
    c = F.col(c) if isinstance(c, str) else c
    p = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})[,.](\d{1,3})$"
    n = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, p, k), F.lit("")).cast("long"), F.lit(0))
    return F.when(c.rlike(p), n(1) * 3_600_000 + n(2) * 60_000 + n(3) * 1000 + F.rpad(F.regexp_extract(c, p, 4), 3, "0").cast("long"))


def subtitle_time(ms: Column | str, style: str = "srt") -> Column:
    """DT15: the time of day of a cue; ass keeps centiseconds only."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    h, m, s, x = F.floor(ms / 3_600_000), F.pmod(F.floor(ms / 60_000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000))
    if style == "ass":
        return F.format_string("%d:%02d:%02d.%02d", h, m, s, F.floor(x / 10))
    return F.format_string("%02d:%02d:%02d" + ("," if style == "srt" else ".") + "%03d", h, m, s, x.cast("long"))


def time_text(c: Column | str, pattern: str = "YYYY-MM-DD HH:mm:ss") -> Column:
    """DT12: a time in a pattern of YYYY, MM, DD, HH, mm and ss; anything else stands for itself."""
    tokens = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
    parts = [p for p in re.split("(YYYY|MM|DD|HH|mm|ss)", pattern) if p]
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(*[F.date_format(c, tokens[p]) if p in tokens else F.lit(p) for p in parts])
