"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The learner sees a bounded, hash-chosen sample of the labelled rows (``max_fit_rows`` in expectation, half of it for
each class at most). Document frequencies of the hashed n-grams are counted by Spark, the strongest ``n_features`` are
kept, and a ridge-penalised logistic regression on presence times log-count ratio is fitted to the kept features of the
sample. Scoring is a map over the documents: no shuffle, and a model of ``n_features`` numbers.

Defined results: a null text counts as empty; an empty text gets the score of the intercept alone; repeated documents
are scored each; several labels of one document count as toxic if one does; null labels are ignored; without rows of
both classes every score is the share of toxic rows (0 without any row). Only doc_id and text are read from documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_below
from .ngrams import Distinct, hashed, slices

SIZES = (3, 6)
BITS = 22


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray  # log-count ratio times learned weight
    intercept: float


def normal(text: str | None) -> str:
    return f" {' '.join((text or '').lower().split())} "


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either class that hold each bucket, one row for each bucket a task has seen."""
    distinct, seen = Distinct(1 << BITS), np.zeros((2, 1 << BITS), np.int32)
    for pdf in frames:
        for text, toxic in zip(pdf.text, pdf.toxic, strict=True):
            seen[toxic, distinct(hashed(normal(text), SIZES, BITS))] += 1
    at = np.flatnonzero(seen.sum(0))
    for a in range(0, len(at), 200_000):
        k = at[a : a + 200_000]
        yield pd.DataFrame({"bucket": k.astype(np.int32), "neg": seen[0, k].astype(np.int64), "pos": seen[1, k].astype(np.int64)})


def _lookup(buckets: np.ndarray) -> np.ndarray:
    lut = np.full(1 << BITS, -1, np.int16)
    lut[buckets] = np.arange(len(buckets), dtype=np.int16)
    return lut


def _features(buckets: np.ndarray) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lut, distinct = _lookup(buckets), Distinct(len(buckets) + 1)
        for pdf in frames:
            rows = []
            for text in pdf.text:
                f = lut[hashed(normal(text), SIZES, BITS)]
                rows.append(distinct(f[f >= 0]).astype(np.int16).tobytes())
            yield pd.DataFrame({"toxic": pdf.toxic, "features": rows})

    return run


def _logistic(sizes: np.ndarray, features: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float, steps: int = 12) -> tuple[np.ndarray, float]:
    """Newton's method, each step solved by conjugate gradients, on the mean log loss plus a ridge (not on the intercept).
    The rows' features stay packed one after another (sizes: how many each row has) and are widened a block of rows at a time."""
    n, d = len(y), len(scale)
    weight, ridge = np.full(n, 1 / max(1, n)), np.append(np.full(d, l2), 0.0)
    at = np.append(0, np.cumsum(sizes))

    def times(v: np.ndarray) -> np.ndarray:
        out, x = np.empty(n), v[:d] * scale
        for s in slices(n, 256):
            out[s] = np.bincount(np.repeat(np.arange(s.stop - s.start), sizes[s]), x[features[at[s.start] : at[s.stop]]], minlength=s.stop - s.start)
        return out + v[d]

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(d)
        for s in slices(n, 256):
            out += np.bincount(features[at[s.start] : at[s.stop]], np.repeat(g[s], sizes[s]), minlength=d)
        return np.append(out * scale, g.sum())

    loss = lambda v, m: (weight * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (ridge * v * v).sum()
    w = np.zeros(d + 1)
    m = times(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        grad, curve = back((p - y) * weight) + ridge * w, np.maximum(p * (1 - p), 1e-9) * weight
        step, r = np.zeros(d + 1), -grad
        q, rr = r.copy(), r @ r
        if rr < 1e-14:
            break
        for _ in range(40):
            hq = back(curve * times(q)) + ridge * q
            a = rr / max(q @ hq, 1e-300)
            step, r = step + a * q, r - a * hq
            new = r @ r
            if new < 1e-4 * (grad @ grad):
                break
            q, rr = r + new / rr * q, new
        now, size = loss(w, m), 1.0
        while size > 1e-4 and loss(w + size * step, trial := times(w + size * step)) > now:
            size /= 2
        w, m = w + size * step, trial
    return w[:d], float(w[d])


def fit(documents: DataFrame, labels: DataFrame, *, learn: Column | None = None, max_fit_rows: int = 20_000, n_features: int = 8_192, smooth: float = 1.0, l2: float = 1e-4) -> Model:
    """learn: which labelled rows may be learned from (a condition on doc_id)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known if learn is None else known.where(learn)
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        share = float(1 in n)
        return Model(np.zeros(0, np.int32), np.zeros(0), 40.0 * (2 * share - 1))
    share = {k: min(1.0, max_fit_rows / 2 / v) for k, v in n.items()}
    chosen = known.where(F.when(F.col("toxic") == 1, hash_below(F.col("doc_id"), share[1], 1)).otherwise(hash_below(F.col("doc_id"), share[0], 1)))
    # max_fit_rows ids at most in expectation, 12 bytes each: a bounded broadcast.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counts = sample.mapInPandas(_counts, "bucket int, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    n1, n0 = (float(n[k] * share[k]) for k in (1, 0))
    p, q = F.col("pos") / n1, F.col("neg") / n0
    pooled = (F.col("pos") + F.col("neg") + 1) / (n1 + n0 + 2)
    best = counts.where("pos + neg >= 3").select("bucket", "pos", "neg", F.abs((p - q) / F.sqrt(pooled * F.greatest(1 - pooled, F.lit(1e-6)) + 1e-9)).alias("z"))
    best = best.orderBy(F.desc("z"), "bucket").limit(n_features).toPandas().sort_values("bucket")
    buckets = best.bucket.to_numpy(np.int32)
    pos, neg = best.pos.to_numpy(float) + smooth, best.neg.to_numpy(float) + smooth
    ratio = np.log(pos / (n1 + 2 * smooth)) - np.log(neg / (n0 + 2 * smooth))
    got = sample.mapInPandas(_features(buckets), "toxic int, features binary").toPandas()
    sizes = got.features.map(len).to_numpy() // 2
    flat = np.frombuffer(b"".join(got.pop("features")), np.int16)
    w, b = _logistic(sizes, flat, got.toxic.to_numpy(float), ratio, l2)
    return Model(buckets, w * ratio, b)


def _scores(texts: pd.Series | list, model: Model, lut: np.ndarray, distinct: Distinct) -> np.ndarray:
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        f = lut[hashed(normal(text), SIZES, BITS)]
        out[i] = model.intercept + model.weights[distinct(f[f >= 0])].sum()
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of documents."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lut, distinct = _lookup(model.buckets), Distinct(len(model.buckets) + 1)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": _scores(pdf.text, model, lut, distinct)})

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")


def reject(documents: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below the threshold: one map, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, distinct = _lookup(model.buckets), Distinct(len(model.buckets) + 1)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text").to_pylist(), model, lut, distinct) < threshold))

    return documents.mapInArrow(run, documents.schema)
