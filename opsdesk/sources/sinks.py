"""Writers (SNK1-SNK3, SNK5, SNK6, SNK9): each a distributed write; existing data is an error unless overwriting is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_escape


def write_csv(df: DataFrame, path: str, *, delimiter: str = ",", overwrite: bool = False) -> None:
    """SNK1: quotes only where they are needed."""
    cells = [csv_escape(F.col(c).cast("string"), delimiter) for c in df.columns]
    head = delimiter.join(df.columns)
    out = df.select(F.concat_ws(delimiter, *cells).alias(head))
    out.write.mode("overwrite" if overwrite else "error").option("header", "true").option("quote", "").option("escape", "").option("sep", "\x01").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def report(df: DataFrame) -> DataFrame:
    """SNK3: each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_report(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    report(df).write.mode("overwrite" if overwrite else "error").text(path)


def write_manifest(entries: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """SNK5: one JSON line for each file; manifest_entries reads the single-document form of other tools."""
    entries.select("path", "bytes", "hash", "mtime").write.mode("overwrite" if overwrite else "error").json(path)


def write_deletions(dups: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """SNK6: the paths beyond the kept copy, as text. Nothing is deleted."""
    dups.where("rank > 1").select("path").write.mode("overwrite" if overwrite else "error").text(path)
