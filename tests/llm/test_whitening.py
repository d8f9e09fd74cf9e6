import math
import random
from fractions import Fraction

import numpy as np
import pytest

from opsdesk.llm import queries, whitening


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def grid(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def exact_covariance(once):
    n, d = len(once), len(once[0])
    s = [sum(x[i] for x in once) for i in range(d)]
    c = [[Fraction(x[i] * n - s[i], n) for i in range(d)] for x in once]
    return n, s, np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(d)] for i in range(d)])


def table(seed, dim, n, spread=1.0):
    r = random.Random(seed)
    mix = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(dim)]
    rows = []
    for i in range(n):
        z = [r.gauss(0, 1) * spread**k for k in range(dim)]
        rows.append((i, [5 + sum(a * b for a, b in zip(z, m, strict=True)) for m in mix]))
    return rows


@pytest.mark.parametrize(("dim", "n", "spread"), [(6, 300, 1.0), (20, 900, 0.7)])
def test_against_exact_covariance(spark, dim, n, spread):
    rows = table(3, dim, n, spread)
    rows += [(n + i, rows[5][1]) for i in range(100)] + [(5, rows[6][1]), (None, rows[7][1]), (9001, None), (9002, [math.nan] * dim), (9003, [1.0] * (dim - 1) + [None]), (9004, [math.inf] + [0.0] * (dim - 1))]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "vec_id long, embedding array<float>, n int, x string").repartition(5)
    got = whitening.whiten(df).collect()
    kept = [(i, grid(v)) for i, v in rows if usable(v)]
    once = sorted({x for _, x in kept})
    count, s, v = exact_covariance(once)
    e, axes = np.linalg.eigh(v)
    e, axes, k = e[::-1], axes[:, ::-1], min(16, dim)
    assert len(got) == len(kept) * k and {r.n for r in got} == {count}
    far = {}
    for i, x in kept:
        far.setdefault(i, set()).add(sum((count * a - b) ** 2 for a, b in zip(x, s, strict=True)))
    assert all(r.deviation in far[r.vec_id] for r in got)
    by_row = {}
    for r in got:
        if r.vec_id is not None and r.vec_id != 5:
            by_row.setdefault(r.vec_id, {})[r.component] = r
    sign = {}
    for i, x in kept:
        if i is None or i == 5:
            continue
        for c in range(k):
            want = float(np.array([float(Fraction(a * count - b, count)) for a, b in zip(x, s, strict=True)]) @ axes[:, c] / math.sqrt(e[c]))
            r = by_row[i][c + 1]
            sign.setdefault(c, 1 if r.whitened * want >= 0 else -1)
            assert r.whitened * sign[c] == pytest.approx(want, abs=1e-7)
            assert r.explained == pytest.approx(e[c] / np.trace(v), rel=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_sums_of_products_are_exact_to_double_double():
    r = np.random.default_rng(5)
    x = r.integers(-1000, 1000, (700, 5)) + 10**9
    n, s = len(x), x.sum(axis=0).tolist()
    high, low = whitening.outer_sum(*whitening.centred(x, whitening.Fit(n, s)))
    for i in range(5):
        for j in range(5):
            want = sum(Fraction(int(a[i]) * n - s[i], n) * Fraction(int(a[j]) * n - s[j], n) for a in x)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want) <= abs(high[i, i] * high[j, j]) ** 0.5 * 2**-75


def test_large_numbers_and_lengths(spark):
    rows = [(1, [1.0e30, 1.0]), (2, [-1.0e30, 2.0]), (3, [0.0, 5.0]), (4, [1.0]), (5, [2.0]), (6, [2.0]), (7, []), (8, [1.0, 1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by) == [1, 2, 3, 4, 5, 6]  # an empty vector and one that is alone in its length have no component
    assert by[1][0].deviation is None and by[4][0].n == 2 and by[4][0].deviation == 64**2
    assert sorted({abs(r.whitened) for i in (4, 5, 6) for r in by[i]}) == [1.0]


def test_small_directions_are_told_apart(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([-1, 1]) * 30_000.0, r.choice([-1, 1]) / 64, (r.random() < 0.5) / 64.0]) for i in range(500)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, s, v = exact_covariance(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in x) for _, x in rows}))
    e = np.linalg.eigvalsh(v)[::-1]
    assert {r.n for r in got} == {n} and got[0].identity_error < 1e-4
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-4)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_registered(spark):
    assert "op11_whitening" in queries.QUERIES
