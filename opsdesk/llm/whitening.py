"""Whitening of embeddings over a compensated covariance.

Vectors are put on an integer grid; the fit list holds each distinct one once, and its sums are exact. Entries are centred as
double-double numbers before anything is multiplied. Outer products are summed by blocks of rows with error-free
transformations: each centred column is cut into slices of so few bits that a product of two slices, summed over a block,
is exact in a double, and these exact matrices are added in double-double. Tasks give a high and a low part of each row of
their matrix, which are merged, high with low, in two steps of bounded groups (a row of the matrix, 64 tasks).

The covariance is solved by tridiagonal divide and conquer (LAPACK's symmetric solver: reduction to tridiagonal form, then
divide and conquer), and its eigenvectors are refined once in extended precision against the double-double matrix. The driver
holds one matrix of dim x dim numbers, whatever the number of rows.

Defined results: vectors that are null or hold null or non-finite entries take no part; entries beyond 2^60 on the grid are held
there; each length of vector is fitted by itself; an empty vector has no components; directions without variance (an
eigenvalue below dim * 2^-50 of the largest) are no components, so that one distinct vector gives no rows; rows without or
with a repeated vec_id are rows like others; a deviation that does not fit 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

_ROWS = 1024  # of a block
_BITS = 21  # of a slice: 2 * 21 bits and the sum of 1,024 products fit 53
_SLICES = 4
_MERGED = 64


class Fit(NamedTuple):
    n: int
    sums: list[int]


class Model(NamedTuple):
    fit: Fit
    axes: np.ndarray  # dim x components, unit columns
    values: np.ndarray  # eigenvalues
    share: np.ndarray  # of the trace


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a double and what it rounds off."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """a * b as a double and what it rounds off."""

    def halves(x):
        t = 134217729.0 * x
        high = t - (t - x)
        return high, x - high

    p, (a1, a2), (b1, b2) = a * b, halves(a), halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A double-double sum."""
    s, e = two_sum(high, more)
    return two_sum(s, e + (low + more_low))


def scaled(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - S, exact: 64-bit integers, or Python's where they would not fit."""
    pivot = [s // fit.n for s in fit.sums]
    d = x - np.array(pivot, np.int64)
    rest = np.array([s - fit.n * p for s, p in zip(fit.sums, pivot, strict=True)], np.int64)
    if (int(np.abs(d).max(initial=0)) + 1) * fit.n >= 1 << 62:
        d, rest = d.astype(object), rest.astype(object)
    return d * fit.n - rest


def centred(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n as double-double numbers."""
    exact, n = scaled(x, fit), float(fit.n)
    high = exact.astype(np.float64)
    whole = high.astype(np.int64) if exact.dtype != object else np.frompyfunc(int, 1, 1)(high)
    q = high / n
    p, e = two_product(q, n)
    return two_sum(q, ((high - p) - e + (exact - whole).astype(np.float64)) / n)


def outer_sum(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products, of at most _ROWS rows, as double-double numbers."""
    exponent = np.frexp(np.abs(high).max(axis=0))[1]
    parts = []
    for k in range(_SLICES):
        unit = np.ldexp(1.0, exponent - _BITS * (k + 1))
        s = np.rint(high / unit) * unit
        parts.append(s)
        high, low = two_sum(high - s, low)
    d = high.shape[1]
    out = np.zeros((d, d)), np.zeros((d, d))
    for i, j in sorted(((i, j) for i in range(_SLICES) for j in range(_SLICES - i)), key=sum, reverse=True):  # small ones first
        out = added(*out, parts[i].T @ parts[j])
    return out


def deviation(exact: np.ndarray) -> list[int | None]:
    """Squared distance of each row from the sums, where it fits 64 bits."""
    most = max(int(exact.max(initial=0)), -int(exact.min(initial=0)))
    if most * most * exact.shape[1] < 1 << 63:
        return (exact * exact).sum(axis=1).tolist()
    rows = [sum(int(v) ** 2 for v in row) for row in exact.tolist()]
    return [r if r < 1 << 63 else None for r in rows]


def whitened(x: np.ndarray, m: Model) -> np.ndarray:
    return centred(x, m.fit)[0] @ m.axes / np.sqrt(m.values)


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    for dim, part in pdf.groupby("dim", sort=False):
        yield int(dim), part


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _grid_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's fit list, for each length and place the number of vectors and the exact sum."""
    n, sums = {}, {}
    for pdf in frames:
        for dim, part in _by_length(pdf):
            x = _matrix(part.x)
            small = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            n[dim] = n.get(dim, 0) + len(x)
            sums[dim] = sums.get(dim, np.zeros(dim, object)) + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
    rows = [(d, at, n[d], Decimal(int(s))) for d in n for at, s in enumerate(sums[d])]
    yield pd.DataFrame(rows, columns=["dim", "at", "n", "s"])


def _partial(models: dict, block: Callable) -> Callable:
    """Double-double sums of block(rows, model) over a task's fit list, as rows of the matrix for each length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for pdf in frames:
            for dim, part in _by_length(pdf.loc[pdf.dim.isin(list(models))]):
                x = _matrix(part.x)
                for a in range(0, len(x), _ROWS):
                    more = block(x[a : a + _ROWS], models[dim])
                    total[dim] = added(*total[dim], *more) if dim in total else more
        rows = [(d, at, h.tolist(), low.tolist()) for d, m in total.items() for at, (h, low) in enumerate(zip(*m, strict=True))]
        yield pd.DataFrame(rows, columns=["dim", "at", "high", "low"])

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(len(pdf.high.iloc[0])), np.zeros(len(pdf.high.iloc[0]))
    for high, low in zip(pdf.high, pdf.low, strict=True):
        out = added(*out, np.asarray(high), np.asarray(low))
    return pd.DataFrame({"dim": pdf.dim.iloc[:1], "at": pdf["at"].iloc[:1], "part": [0], "high": [out[0].tolist()], "low": [out[1].tolist()]})


def _summed(fit: DataFrame, models: dict, block: Callable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums of all tasks: for each length a matrix of high and one of low parts."""
    row = "dim int, at int, high array<double>, low array<double>"
    parts = cut(fit.mapInPandas(_partial(models, block), row).withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(_MERGED)).cast("int")))
    schema = "dim int, at int, part int, high array<double>, low array<double>"
    some = parts.groupBy("dim", "at", "part").applyInPandas(_merge, schema)
    rows = some.groupBy("dim", "at").applyInPandas(_merge, schema).orderBy("dim", "at").collect()  # dim rows for each length
    drop(parts)
    out = {}
    for r in rows:
        out.setdefault(r.dim, ([], []))[0].append(r.high)
        out[r.dim][1].append(r.low)
    return {d: (np.array(h), np.array(low)) for d, (h, low) in out.items()}


def solve(high: np.ndarray, low: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes, eigenvalues and shares of the trace of the matrix (high + low) / n, the largest first."""
    v = (high.astype(np.longdouble) + low) / n
    v = (v + v.T) / 2
    _, axes = np.linalg.eigh(v.astype(np.float64))
    x = axes[:, ::-1].astype(np.longdouble)
    # One step of refinement: what the axes lack in being orthogonal, and in making v diagonal.
    r, s = np.eye(len(v)) - x.T @ x, x.T @ v @ x
    e = np.diag(s) / (1 - np.diag(r))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > 2 * np.abs(s - np.diag(e)).max(initial=0) + np.abs(e).max(initial=0) * 2.0**-52
    x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    e = ((v @ x) * x).sum(axis=0)
    order = [i for i in np.argsort(-e, kind="stable") if e[i] > len(v) * 2.0**-50 * e.max()][:most]
    return x[:, order].astype(np.float64), e[order].astype(np.float64), (e[order] / np.trace(v)).astype(np.float64)


def fit(vectors: DataFrame, *, components: int = 16) -> tuple[dict[int, Model], dict[int, float]]:
    """vectors: dim and x. For each length the model, and the largest entry by which the covariance of the whitened fit list
    differs from the identity."""
    once = cut(vectors.select("dim", "x").distinct())
    fits = {}
    for r in once.mapInPandas(_grid_sums, "dim int, at int, n long, s decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "at").collect():
        fits.setdefault(r.dim, Fit(r.n, [])).sums.append(int(r.s))
    products = _summed(once, fits, lambda x, f: outer_sum(*centred(x, f))) if fits else {}
    models = {d: Model(fits[d], *solve(*products[d], fits[d].n, components)) for d in products}
    models = {d: m for d, m in models.items() if len(m.values)}
    error = {}
    if models:
        sums = _summed(once, models, lambda x, m: (whitened(x, m).sum(axis=0)[None, :], np.zeros((1, len(m.values)))))
        means = {d: (models[d], (h + low)[0] / models[d].fit.n) for d, (h, low) in sums.items()}
        square = _summed(once, means, lambda x, m: outer_sum(*two_sum(whitened(x, m[0]), -m[1])))
        error = {d: float(np.abs((h + low) / models[d].fit.n - np.eye(len(h))).max()) for d, (h, low) in square.items()}
    drop(once)
    return models, error


def _projected(models: dict[int, Model], error: dict[int, float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in _by_length(pdf.loc[pdf.dim.isin(list(models))]):
                m = models[dim]
                x, k = _matrix(part.x), len(m.values)
                far = pd.array(deviation(scaled(x, m.fit)), "Int64")
                yield pd.DataFrame({
                    "vec_id": part.vec_id.repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": m.fit.n, "deviation": far.repeat(k),
                    "whitened": whitened(x, m).ravel(), "explained": np.tile(m.share, len(x)), "identity_error": error[dim],
                })

    return run


def on_grid(vectors: DataFrame, *, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, dim and x, the vectors as long numbers floor(scale * c) + offset."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    number = lambda c: F.floor(F.least(F.greatest(F.lit(scale) * c.cast("double"), F.lit(-(2.0**60))), F.lit(2.0**60))).cast("long") + F.lit(offset)
    return vectors.where(F.col("embedding").isNotNull()).where(whole).select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", number).alias("x"))


def whiten(vectors: DataFrame, *, scale: int = 64, offset: int = 1_000_000, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row of vectors (vec_id, embedding) and
    component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = cut(on_grid(vectors, scale=scale, offset=offset))
    models, error = fit(rows, components=components)
    return rows.mapInPandas(_projected(models, error), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
