"""Exact top-k search by inner product with vector-approximation files.

Two files are written once: the exact vectors, and their approximations, the number of the cell that each component lies
in (one byte; cells divide each dimension's range over all vectors). The scan reads approximations only: the cell centres'
inner product, plus and minus what the cells leave open, bounds the true one from both sides. A block of approximations
returns what may be among its own k best; the kth best lower bound over all blocks is a score that a result must reach.
Exact vectors are then fetched by id, for what is left, in the order of the upper bounds: the first 2k of each query, and
after them only those whose upper bound reaches the kth exact score found. No other can be among the results.

Queries meet all rows in blocks: approximations are dealt into blocks of about ``block`` rows and queries into chunks of
about ``chunk``, both by a hash, and each pair of the two is one bounded task group. So no group grows with the data, and
what is repeated for each chunk is one byte a dimension.

Defined results: vectors that are null or hold null or non-finite components take no part; a query meets only vectors
of its own length; repeated ids are separate candidates,
a query never meets a row that has its own id, and of query rows that repeat an id the smallest vector is asked; with fewer than k
candidates all are ranked; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, wide
from .ngrams import slices

CELLS = 256  # of each dimension
_STEP = 256  # queries bounded at once


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of every query's inner product with every vector."""
    half = (width - 1) / 2
    most = float(np.abs(q).max(initial=0)) * float(np.abs(low).max(initial=0) + width.max(initial=1) * CELLS) * q.shape[1]
    kind = np.float32 if most < 1 << 22 else np.float64
    middle = q.astype(kind) @ (low + half + cells * width.astype(kind)).T.astype(kind)
    slack = (np.abs(q) @ half)[:, None] + (most * 2.0**-50 if most >= 1 << 50 else 0)  # what doubles round off
    return middle + slack.astype(kind), middle - slack.astype(kind)


def _cells(grids: dict) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cells = [((np.asarray(v) - grids[len(v)][0]) // grids[len(v)][1]).astype(np.uint8).tobytes() for v in pdf.v]
            yield pd.DataFrame({"row": pdf.row, "id": pdf.id, "dim": pdf.dim, "cells": cells})

    return run


def _scan(k: int, grids: dict) -> Callable:
    """For each query of a chunk, the rows of a block that may be among its k best."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "low": np.zeros(0), "high": np.zeros(0)})]
        n = len(rows)
        if n:
            cells = np.frombuffer(b"".join(rows.cells), np.uint8).reshape(n, -1)
            ids, row, asked = rows.id.to_numpy(), rows.row.to_numpy(), queries.id.to_numpy()
            for s in slices(len(queries), _STEP):
                high, low = _bounds(_matrix(queries.v[s]), cells, *grids[key[0]])
                own = asked[s][:, None] == ids[None, :]
                high[own] = low[own] = -np.inf
                least = np.partition(low, n - min(k, n), 1)[:, n - min(k, n)]
                i, j = np.nonzero((high >= least[:, None]) & ~own)
                out.append(pd.DataFrame({"query_id": asked[s][i], "row": row[j], "low": low[i, j].astype(float), "high": high[i, j].astype(float)}))
        return pd.concat(out)

    return run


def top_k(vectors: DataFrame, queries: Column, *, k: int = 20, scale: int = 64, block: int = 16_384, chunk: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the rows of vectors (vec_id, embedding) for each row that the condition
    ``queries`` holds for; components count as floor(scale * x), scores are their integer inner products."""
    number = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = vectors.where(usable).where(whole).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", number).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    v = cut(v.withColumn("dim", F.size("v")))
    n = {r.dim: (r.n, r.q) for r in v.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).collect()}
    blocks, chunks = max([1, *(-(-a // block) for a, _ in n.values())]), max([1, *(-(-b // chunk) for _, b in n.values())])
    grids = {d: (np.zeros(d), np.ones(d)) for d in n}
    for r in v.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect():
        grids[r.dim][0][r.at], grids[r.dim][1][r.at] = r.low, max(1, -(-(r.high - r.low + 1) // CELLS))
    # Of a vector that many rows repeat, only those of the k + 1 smallest ids (a query meets none of its own), and k of each id, can
    # be among anybody's k best. Copies are counted before they are dealt, so a common vector is a row of each task.
    folded = v.groupBy("dim", "v", "id").agg(F.count(F.lit(1)).alias("n"))
    few = folded.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1)
    few = few.select("id", "dim", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k))))).drop("col")
    few = cut(few.withColumn("row", F.monotonically_increasing_id()))
    cells = cut(few.select("row", "id", "dim", "v").mapInPandas(_cells(grids), "row long, id long, dim int, cells binary"))
    rows = cells.select("row", "id", "cells", "dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"))
    once = cut(v.where("is_query").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.*"))
    asked = once.select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("c"))
    keys = ["dim", "b", "c"]
    seen = cut(asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_scan(k, grids), "query_id long, row long, low double, high double"))

    best = seen.select("query_id", "low", F.row_number().over(_by_query(F.desc("low"))).alias("rank")).where(F.col("rank") <= k)
    least = best.groupBy("query_id").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    live = seen.join(wide(cut(least)), "query_id", "left").where("least is null or high >= least")
    live = cut(live.select("query_id", "row", "high", F.row_number().over(_by_query(F.desc("high"), F.col("row"))).alias("nth")))

    def exact(some: DataFrame) -> DataFrame:
        found = some.select("query_id", "row").join(wide(few.select("row", F.col("id").alias("vec_id"), F.col("v").alias("x"))), "row")
        both = found.join(wide(once.select(F.col("id").alias("query_id"), F.col("v").alias("y"))), "query_id")
        return both.select("query_id", "vec_id", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))

    first = cut(exact(live.where(F.col("nth") <= 2 * k)))
    ranked = first.select("query_id", "score", F.row_number().over(_by_query(F.desc("score"))).alias("rank"))
    kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = live.where(F.col("nth") > 2 * k).join(wide(cut(kth)), "query_id").where(F.col("high") >= F.col("kth"))
    found = first.union(exact(rest))
    out = found.withColumn("rank", F.row_number().over(_by_query(F.desc("score"), F.col("vec_id"))).cast("int"))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_query(*order: Column):
    return Window.partitionBy("query_id").orderBy(*order)
