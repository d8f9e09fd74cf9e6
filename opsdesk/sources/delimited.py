"""Delimited text of any dialect (SRC2-SRC5, SRC10-SRC12, SRC16, PRJ1)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim_u
from ..shared import discard, written
from .files import texts


@lru_cache(maxsize=64)
def _cell(delimiter: str) -> re.Pattern:
    """A cell, of plain and quoted stretches, and what ends it."""
    d = re.escape(delimiter)
    return re.compile(rf'((?:[^"\n{d}]++|"(?:[^"]++|"")*+(?:"|\Z))*+)({d}|\n|\Z)')


_QUOTED = re.compile(r'"((?:[^"]++|"")*+)(?:"|\Z)|\r')


def parse(text: str, delimiter: str) -> list[list[str]]:
    """Cells of each record: a quoted stretch may be any part of a cell, two quotes in it are one, line ends in it stay and
    carriage returns outside of it go; records of one blank cell are left out."""
    rows, row = [], []
    for m in _cell(delimiter).finditer(text):
        cell, end = m.groups()
        row.append(_QUOTED.sub(lambda q: (q[1] or "").replace('""', '"'), cell) if '"' in cell or "\r" in cell else cell)
        if end != delimiter:
            rows.append(row)
            row = []
        if not end:
            break
    return [r for r in rows if len(r) > 1 or r[0].strip()]


def sniff(text: str, order: str = ",;\t|") -> str:
    """SRC3: the most frequent delimiter of the first line, of equals the first in order."""
    first = text.split("\n", 1)[0]
    return max(order, key=lambda d: (first.count(d), -order.index(d)))


def sniff_consistent(text: str, order: str = ",;\t|") -> str:
    """SRC4: the delimiter under which a sample's records agree best on a large number of columns."""
    def score(d: str) -> float:
        sizes = [len(r) for r in parse(text, d)[:50]]
        if not sizes:
            return 0.0
        usual = max(set(sizes), key=lambda n: (sizes.count(n), -sizes.index(n)))
        return usual * sizes.count(usual) / len(sizes) * (0.5 if usual == 1 else 1)

    return max(order, key=lambda d: (score(d), -order.index(d)))


def delimiters(text: Column | str, *, consistent: bool = True) -> Column:
    """SRC3, SRC4: the delimiter of each text, a sample of a file."""
    choose = sniff_consistent if consistent else sniff

    @F.pandas_udf("string")
    def chosen(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: choose(t or ""))

    return chosen(text)


def records(spark: SparkSession, path: str, delimiter: str | None = None, **options) -> DataFrame:
    """SRC2: doc_id (file), line (record number from 1), cells of every file; a file is parsed in one task, so this is for many
    files of moderate size. split_records() takes files of any size."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, k, r) for d, t in zip(pdf.doc_id, pdf.text, strict=True) for k, r in enumerate(parse(t or "", delimiter or sniff(t or "")), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "cells"])

    return texts(spark, path, **options).mapInPandas(run, "doc_id string, line long, cells array<string>")


def _ranges(delimiter: str, inside: set):
    """Rows (doc_id, block, value) are the lines of byte ranges in order. Records that lie in a range are parsed there (k: their number in
    the range, cells); the lines before the first record end of a range that begins inside quotes (k = 0), and those of a last record that is
    still open, come as text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lines, done, k = None, [], [], 0
        odd = head = False

        def flush(end: bool) -> pd.DataFrame:
            nonlocal done, lines, k, head
            rows = []
            for cells in parse("\n".join(done), delimiter) if done else ():
                k += 1
                rows.append((*at, k, cells, None))
            done = []
            if end and lines:
                rows.append((*at, 0 if head else k + 1, None, "\n".join(lines)))
                lines = []
            return pd.DataFrame(rows, columns=["doc_id", "block", "k", "cells", "text"])

        for pdf in frames:
            for doc, block, value in zip(pdf.doc_id, pdf.block, pdf.value, strict=True):
                if (doc, block) != at:
                    if at:
                        yield flush(True)
                    at, k = (doc, block), 0
                    odd = head = at in inside
                lines.append(value)
                odd ^= value.count('"') % 2 == 1
                if not odd:
                    if head:
                        yield pd.DataFrame([(*at, 0, None, "\n".join(lines))], columns=["doc_id", "block", "k", "cells", "text"])
                    else:
                        done += lines
                    head, lines = False, []
            if at:
                yield flush(False)
        if at:
            yield flush(True)

    return run


def split_records(spark: SparkSession, path: str, delimiter: str | None = None, *, encoding: str = "UTF-8", max_open: int = 1_000_000) -> DataFrame:
    """SRC2 for files of any size: records() of one dialect, parsed by byte ranges. Whether a range begins inside quotes is the parity of the
    quotes before it: each range counts its own, and a running sum over the ranges of a file (one row each) settles all. Then ranges are
    parsed alone, and a record that goes over a border is put together from the pieces of its ranges. Only the ranges that begin inside
    quotes are sent to the tasks, after a check of their number."""
    lines = spark.read.option("lineSep", "\n").text(path)
    text = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    first = F.col("block") == 0
    lines = lines.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), text.alias("value"))
    lines = lines.withColumn("value", F.when(first & F.col("value").startswith("\ufeff"), F.expr("substring(value, 2)")).otherwise(F.col("value")))
    if delimiter is None:
        head = lines.where(first).first()
        delimiter = sniff(head.value if head else "")
    of_file = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quotes = lines.groupBy("doc_id", "block").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    begins = quotes.withColumn("before", F.sum("n").over(of_file)).where("before % 2 = 1").select("doc_id", "block").limit(max_open + 1).collect()
    if len(begins) > max_open:
        raise ValueError(f"more than {max_open} ranges begin inside quotes; read with a larger spark.sql.files.maxPartitionBytes")
    inside = {(r.doc_id, r.block) for r in begins}
    parts = written(lines.mapInPandas(_ranges(delimiter, inside), "doc_id string, block long, k long, cells array<string>, text string"))
    whole = parts.where("text is null").select("doc_id", "block", "k", "cells")
    pieces = parts.where("text is not null").withColumn("record", F.count_if(F.col("k") > 0).over(Window.partitionBy("doc_id").orderBy("block", "k")))
    piece = F.sort_array(F.collect_list(F.struct("block", "k", "text")))
    owner = F.min(F.when(F.col("k") > 0, F.struct("block", "k")))
    joined = pieces.groupBy("doc_id", "record").agg(owner.alias("o"), F.array_join(F.transform(piece, lambda x: x.text), "\n").alias("text")).select("doc_id", "o.block", "o.k", "text")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, b, k, cells) for d, b, k, t in zip(pdf.doc_id, pdf.block, pdf.k, pdf.text, strict=True) for cells in parse(t, delimiter)]
            yield pd.DataFrame(rows, columns=["doc_id", "block", "k", "cells"])

    rows = written(whole.union(joined.mapInPandas(parsed, "doc_id string, block long, k long, cells array<string>")))
    discard(parts)
    counts = rows.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "block", F.coalesce(F.sum("n").over(of_file), F.lit(0)).alias("before"))
    return rows.join(counts.hint("merge"), ["doc_id", "block"]).select("doc_id", (F.col("before") + F.col("k")).alias("line"), "cells")


def table(rows: DataFrame, *, header: list[str] | None = None) -> DataFrame:
    """SRC5: records of one dialect as columns of text, with line; the first record is the header unless one is given."""
    names = header or [c.strip() or f"c{k + 1}" for k, c in enumerate(rows.where("line = 1").first().cells)]
    body = rows if header else rows.where("line > 1")
    return body.select("line", *[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


def _marked_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(trim_u("value").alias("v")).where(~F.col("v").startswith("#") & (F.col("v") != "")).select(F.split("v", r"\|").alias("x"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: category, word, variants of lines category|word|variant...; # starts a comment."""
    return _marked_lines(spark, path).where(F.size("x") >= 2).select(F.trim(F.col("x")[0]).alias("category"), F.trim(F.col("x")[1]).alias("word"), F.filter(F.transform(F.slice("x", F.lit(3), F.size("x")), lambda v: F.trim(v)), lambda v: v != "").alias("variants"))


def holiday_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: d, kind of lines date|holiday or date|workday; others are left out."""
    x = _marked_lines(spark, path).select(F.try_to_date(F.trim(F.get("x", F.lit(0))), "yyyy-MM-dd").alias("d"), F.lower(F.trim(F.get("x", F.lit(1)))).alias("kind"))
    return x.where("d is not null and kind in ('holiday', 'workday')")


def limit_list(rows: DataFrame) -> DataFrame:
    """SRC12: type, cents of two-column records; the last of a type counts, unreadable amounts (a header) don't."""
    from ..functions.numbers import parse_number

    x = rows.select("line", F.get("cells", F.lit(0)).alias("type"), parse_number(F.get("cells", F.lit(1)), "cents").alias("cents")).where("cents is not null")
    return x.groupBy("type").agg(F.max_by("cents", "line").alias("cents"))


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: path, bytes, hash, mtime of a manifest's files."""
    schema = "files array<struct<path string, bytes bigint, hash string, mtime timestamp>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("files").alias("f")).select("f.*")
