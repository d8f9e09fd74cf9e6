"""A training corpus from raw documents: reject toxic texts, drop repeated lines, keep one of each group of near
duplicates, remove benchmark leaks, and mix the sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
reads them again for the next one, so that a stage lost with its executors is repeated from the one before. All stages but
the last return the columns of documents. Empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsdesk.llm import decontam, linededup, mixing, neardup, toxicity
from opsdesk.llm.common import crc_mod, cut, read, wide


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; rows without doc_id are judged like the others, and
    rows that repeat a doc_id each by its own text."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), learn=crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.reject(docs, model, threshold=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines within one edit of each other only the first stays; a document without any line left goes.
    Lines under 20 characters stay, repeated or not (README: how many)."""
    return linededup.dedup_lines(docs, max_edits=1, min_chars=20)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles the one with the smallest doc_id stays. Repeated
    rows of one doc_id stay or go together; of those that stay the one with the smallest text is kept (nulls first)."""
    keep = neardup.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    left = docs.join(wide(cut(keep)), "doc_id", "left_anti").select(*docs.columns)
    twice = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if twice.isEmpty():
        return left
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*left.columns))
    first = left.join(wide(twice), "doc_id", "left_semi").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return left.join(wide(twice), "doc_id", "left_anti").unionByName(first).select(*docs.columns)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of the mixed corpus: doc_id, source, n_tokens, block, start, weight. Every document is read at least
    once, none more than twice."""
    return mixing.mix(docs, max_repeats=2.0)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The classifier, the hashing and the tiling are no SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
