"""File sets and texts (SRC1, SRC6-SRC9, SRC15, SRC17, SRC19). Paths are whatever Spark can read; nothing is opened on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a scan for credentials passes over.
SKIPPED_FOLDERS = ("node_modules", ".git", ".svn", "dist", "build", "out", ".next", "vendor", ".cache", "coverage", "__pycache__")
SKIPPED_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "tar", "woff", "woff2", "ttf", "mp4", "mp3", "exe", "dll", "so", "dylib", "lock")


def files(spark: SparkSession, path: str, *, glob: str | None = None, min_bytes: int = 0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """SRC7, SRC9, PRJ15: path (relative), bytes, mtime, content of the files below a folder; content is read only if it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader if glob is None else reader.option("pathGlobFilter", glob)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    x = reader.load(path).select(F.regexp_replace("path", rf"^[a-zA-Z0-9+.-]*:?/*\Q{root}\E/", "").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content")
    x = x.where(F.col("bytes") >= min_bytes)
    names = F.split("path", "/")
    for e in exclude:
        x = x.where(~F.array_contains(names, e))
    return x


def code_files(spark: SparkSession, path: str, *, max_bytes: int = 2 << 20) -> DataFrame:
    """SRC8: texts worth a scan: not in skipped folders, of skipped kinds, over max_bytes or with a zero byte early on. The tests on
    names and sizes need no content."""
    x = files(spark, path, exclude=SKIPPED_FOLDERS).where(F.col("bytes") <= max_bytes).where(~F.lower("path").rlike(rf"\.({'|'.join(SKIPPED_ENDINGS)})$"))
    return x.where(~F.hex(F.substring("content", 1, 4096)).rlike("^(..)*00"))


def decoded(content: Column | str) -> Column:
    """SRC1: UTF-8 if it is valid, else GB18030; without a byte-order mark. Needs spark.sql.legacy.javaCharsets."""
    c = F.col(content) if isinstance(content, str) else content
    text = F.when(F.is_valid_utf8(c), F.decode(c, "UTF-8")).otherwise(F.decode(c, "GB18030"))
    return F.regexp_replace(text, "^\\uFEFF", "")


def texts(spark: SparkSession, path: str, **options) -> DataFrame:
    """SRC6: doc_id (the path) and text of each file."""
    return files(spark, path, **options).select(F.col("path").alias("doc_id"), decoded("content").alias("text"))


def amount_lines(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    """SRC15: the n-th comma-separated field of each line, as text."""
    return spark.read.text(path).select(F.get(F.split("value", ","), F.lit(column - 1)).alias("amount"))


def front_matter(documents: DataFrame) -> DataFrame:
    """SRC19: doc_id, key, value of the lines between the leading --- marks of a text."""
    head = F.regexp_extract("text", r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    return documents.select("doc_id", F.explode(F.split(head, r"\r?\n")).alias("row")).where(F.col("row").rlike(r"^[\w-]+:")).select("doc_id", F.regexp_extract("row", r"^([\w-]+):", 1).alias("key"), F.trim(F.regexp_replace("row", r"^[\w-]+:\s*", ""), F.lit(" \"'")).alias("value"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """SRC17: doc_id (the commit), at (its date and time as written) and text of each commit of logs with patches, as ``git log -p`` prints them. The reader
    splits at the line that begins a commit, so that one long log is read by many tasks."""
    head = r"(?:^|\n)commit ([0-9a-f]{7,40})"
    raw = spark.read.option("lineSep", "\ncommit ").text(path).select(F.when(F.col("value").startswith("commit "), F.col("value")).otherwise(F.concat(F.lit("commit "), "value")).alias("text"))
    return raw.select(F.regexp_extract("text", head, 1).alias("doc_id"), F.regexp_extract("text", r"\nDate:[ \t]*([^\n]*)", 1).alias("at"), "text").where("doc_id <> ''")


def added_lines(log: DataFrame) -> DataFrame:
    """SRC17: commit, author, date (as written), file, line (in the new file), text of the lines that a log with patches adds
    (doc_id, text: one commit's output a row; without a commit's head, as a staged difference is, the first three are null)."""

    def added(text: str) -> Iterator[tuple]:
        head = text.split("diff --git ", 1)[0]
        who = [m[1].strip() if (m := re.search(p, head, re.M)) else None for p in (r"^commit ([0-9a-f]{7,40})", r"^Author:(.*)$", r"^Date:(.*)$")]
        file, line = None, 0
        for row in text.split("\n"):
            if row.startswith("diff --git "):
                file, line = None, 0
            elif not line and row.startswith("+++ "):
                file = row[4:].removeprefix("b/")
            elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", row):
                line = int(m[1])
            elif line and row.startswith("+"):
                yield *who, file, line, row[1:]
                line += 1
            elif line and row.startswith(" "):
                line += 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([x for t in pdf.text for x in added(t or "")], columns=["commit", "author", "date", "file", "line", "text"])

    return log.select("text").mapInPandas(run, "commit string, author string, date string, file string, line int, text string")
