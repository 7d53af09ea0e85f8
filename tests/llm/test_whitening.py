"""Whitening against numpy's eigenvectors of the covariance, and its solver against numpy's SVD."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most=16):
    """(x by row, n, sums, eigenvalues, eigenvectors) by exact sums and numpy."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, e[::-1], v[:, ::-1]


def check(got, rows, most=16, components=None):
    kept, n, sums, e, v = brute(rows)
    k = components if components is not None else min(most, len(e))
    assert len(got) == k * len(kept)
    want: dict = {}
    for i, x in kept:
        d = n * np.array(x) - sums
        want.setdefault(i, []).append((sum(int(y) ** 2 for y in d), (d / n) @ v[:, :k] / np.sqrt(e[:k])))
    by: dict = {}
    for r in got:
        assert r.n == n and 0 <= r.identity_error <= 1e-4
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-9
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, mine in by.items():
        pairs = lambda sign: sorted((str(i), dev, round(sign * float(y[c - 1]), 6) + 0.0) for i, all_ in want.items() for dev, y in all_)
        found = sorted((str(r.vec_id), r.deviation, round(r.whitened, 6) + 0.0) for r in mine)
        close = lambda a, b: all(p[:2] == q[:2] and abs(p[2] - q[2]) < 1e-5 for p, q in zip(a, b, strict=True))
        assert close(found, pairs(1)) or close(found, pairs(-1))


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 24)) * np.linspace(3, 0.4, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(7, rows[9][1]), (None, rows[3][1]), (900, None), (901, [float("nan")] * 24), (902, [*rows[0][1][:-1], float("inf")]), (903, [None, *rows[0][1][1:]]), (904, [0.0] * 24), (905, [0.5]), (906, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"x": F.lit(1), "component": F.lit("c"), "at": F.lit(2), "r": F.lit(3)})
    good = [r for r in rows if r[1] is None or len(r[1]) == 24]
    check(wh.whiten(df).collect(), good)
    check(wh.whiten(df.withColumn("embedding", F.col("embedding").cast("array<double>")), most=3).collect(), good, most=3)


@pytest.mark.parametrize("rows, components", [([(1, [0.25, 1.0])] * 3, 0), ([(1, [0.0, 1.0]), (2, [1.0, 1.0])], 1), ([(1, [0.0]), (2, [1.0]), (3, [5.0])], 1), ([(i, [float(i), 2.0 * i, i * i / 4]) for i in range(9)], 2)])
def test_dependent_entries_leave_fewer_components(spark, rows, components):
    check(wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows, components=components)


def test_empty_and_far(spark):
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
    far = wh.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 6 and all(r.deviation is None for r in far if r.vec_id < 3)


def test_values_that_several_directions_share(spark):
    """A cube's corners: every direction has the same variance."""
    rows = [(i, [float(i >> b & 1) for b in range(5)]) for i in range(32)]
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    y = np.array([[r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == i] for i in range(32)])
    assert y.shape == (32, 5) and np.abs(y.T @ y / 32 - np.eye(5)).max() < 1e-10 and all(abs(r.explained - 0.2) < 1e-12 for r in got)


def test_reduction_is_the_same_however_many_are_stacked(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 100, (500, 6)) + 1_000_000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(13)
    centre = wh.Centre(500, x.sum(axis=0).tolist())
    want = np.cov(x.T, bias=True) * 500
    for fan in (2, 5, 32):
        r = wh.reduced(df, 6, centre, fan)
        assert r.shape == (6, 6) and np.allclose(r.T @ r, want, rtol=1e-10)


def test_sums_beyond_64_bits_are_exact():
    centre = wh.Centre(3, [1 << 62, 5])
    x = np.array([[1 << 60, 2], [7, 7]])
    assert centre.deviation(x) == [None, None]
    assert [[Fraction(int(v)) for v in row] for row in centre.differences(x)] == [[3 * (1 << 60) - (1 << 62), 1], [21 - (1 << 62), 16]]


@pytest.mark.parametrize("kind", range(6))
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_solver(n, kind):
    rng = np.random.default_rng(n * 7 + kind)
    a, b = rng.standard_normal(n), rng.standard_normal(n - 1)
    if kind == 1:
        a, b = 10.0 ** rng.uniform(-12, 12, n), 10.0 ** rng.uniform(-12, 0, n - 1)
    if kind == 2:
        a, b = np.ones(n), np.zeros(n - 1)
    if kind == 3:
        a, b = np.ones(n), np.full(n - 1, 1e-9)
    if kind == 4:
        b[::3], a[::5] = 0, a[0]
    if kind == 5:
        a[n // 2] = 0
    values = wh.dqds(a, b)
    m = np.diag(a) + np.diag(b, 1)
    assert np.abs(values - np.linalg.svd(m, compute_uv=False)).max() <= 1e-14 * n * values[0]
    top = values[:16][values[:16] > 1e-13 * values[0]]
    z = wh._right_vectors(a, b, top)
    assert np.abs(z.T @ z - np.eye(len(top))).max(initial=0) < 1e-12
    assert np.abs(m.T @ (m @ z) - z * top**2).max(initial=0) <= 1e-13 * n * values[0] ** 2


def test_small_values_keep_their_digits():
    """A graded matrix whose least value is known: the product of all is the product of the diagonal."""
    a, b = 10.0 ** -np.arange(0, 24, 2), 10.0 ** -np.arange(0, 22, 2) / 3
    values = wh.dqds(a, b)
    assert abs(np.prod(values) / np.prod(a) - 1) < 1e-12 and abs(values[-1] / (np.prod(a) / np.prod(values[:-1])) - 1) < 1e-12


def test_bidiagonal_form():
    m = np.random.default_rng(1).standard_normal((9, 9))
    m[:, 3] = 0
    a, b, w = wh.bidiagonal(m)
    assert np.abs(w.T @ w - np.eye(9)).max() < 1e-14
    core = np.diag(a) + np.diag(b, 1)
    assert np.allclose(core.T @ core, w.T @ m.T @ m @ w, atol=1e-13)
