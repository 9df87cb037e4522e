"""Whitening against exact sums and numpy's eigenvectors, and the refinement on hard matrices."""

import math
import random

import numpy as np
import pytest

from firstdue.llm import whitening

ROWS = "vec_id long, embedding array<float>, x string, id map<string,int>"


def whole(rows):
    out = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(256 * float(np.float32(c))) for c in v]))
    dims = max((len(x) for _, x in out), default=0)
    return [(i, x + [0] * (dims - len(x))) for i, x in out], dims


def plain(rows, components=4):
    """n, deviations, covariance and x - S/n per row, from Python's whole numbers."""
    kept, dims = whole(rows)
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[n * x[d] - sums[d] for d in range(dims)] for x in fit]
    cov = np.array(
        [[sum(r[a] * r[b] for r in centred) / n**3 for b in range(dims)] for a in range(dims)], float
    ).reshape(dims, dims)
    deviation = [sum((n * x[d] - sums[d]) ** 2 for d in range(dims)) for _, x in kept]
    away = np.array([[(n * x[d] - sums[d]) / n for d in range(dims)] for _, x in kept], float)
    return kept, n, deviation, cov, away, [tuple(x) for x in fit], sums


def run(spark, rows, parts=5, **options):
    df = spark.createDataFrame([(i, v, "a", {"b": 1}) for i, v in rows], ROWS).repartition(parts)
    got = whitening.whiten(df, **options)
    assert got.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    return got.collect()


def test_whitening_equals_plain_sums(spark):
    rng = random.Random(3)
    rows = [
        (i, [float(np.float32(rng.gauss(0, 1 + 2 / (d + 1)) + 0.5 * d)) for d in range(10)]) for i in range(400)
    ]
    rows += [(i, rows[7][1]) for i in range(1000, 1500)]  # a common vector counts once in the fit
    rows += [(2000, None), (2001, [None] * 10), (2002, [float("nan")] * 10)]
    kept, n, deviation, cov, away, fit, sums = plain(rows)
    got = run(spark, rows)
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} == {400}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    for k in range(4):
        want = away @ vectors[:, k] / np.sqrt(values[k])
        have = np.array([by[i][k + 1].whitened for i, _ in kept])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert by[0][k + 1].explained == pytest.approx(values[k] / np.trace(cov), rel=1e-12)
    assert [by[i][1].deviation for i, _ in kept] == deviation
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-12


@pytest.mark.parametrize("rows", [
    [],
    [(1, None)],
    [(1, [])],
    [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.5, 0.5])],  # one point
    [(None, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])],  # one direction
    [(1, [1.0, 2.0, 3.0]), (2, [2.0]), (3, [0.0, 5.0])],  # of different length
    [(i, [float(i), float(i)]) for i in range(9)],  # dependent dimensions
])
def test_odd_tables(spark, rows):
    kept, n, deviation, cov, _, _, _ = plain(rows)
    got = run(spark, rows)
    dims = len(cov)
    assert len(got) == len(kept) * min(4, dims)
    spread = np.linalg.matrix_rank(cov) if dims else 0
    for r in got:
        assert r.n == n and (r.whitened is not None) == (r.component <= spread)
        assert (r.explained is None) == (spread == 0) and r.identity_error < 1e-12
    if dims:
        assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)


def test_deviation_beyond_a_long_is_missing(spark):
    rows = [(i, [15_000.0 * (i % 7), float(i)]) for i in range(500)]
    _, _, deviation, _, _, _, _ = plain(rows)
    got = run(spark, rows)
    want = [d if d < 2**63 else None for d in deviation]
    assert None in want and any(want)
    have = {r.vec_id: r.deviation for r in got if r.component == 1}
    assert [have[i] for i, _ in rows] == want


def test_other_names_and_large_entries(spark):
    df = spark.createDataFrame([("a", [0.5, 1.0]), ("b", [1.5, 0.0])], "name string, v array<double>")
    assert {r.name for r in whitening.whiten(df, "name", "v").collect()} == {"a", "b"}
    bad = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="must stay below"):
        whitening.whiten(bad)


def residual(a, values, x):
    high = np.longdouble
    a, x = a.astype(high), x.astype(high)
    return (
        float(np.abs(a @ x - x * values).max() / np.abs(a).max()),
        float(np.abs(x.T @ x - np.eye(len(a))).max()),
    )


@pytest.mark.parametrize("gap", [0.0, 1e-16, 1e-12, 1e-9, 1e-6, 1e-3])
@pytest.mark.parametrize("n", [2, 5, 40])
def test_clustered_eigenvalues(gap, n):
    """Three groups of eigenvalues, ``gap`` apart within a group."""
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)).astype(np.float64))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthonormal in extended precision
        q = q @ (3 * np.eye(n) - q.T @ q) / 2
    want = np.array([3 - k % 3 + gap * k for k in range(n)], np.longdouble)
    a = (q * want) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigenvectors(a)
    assert (np.diff(values) <= 0).all()
    off, skew = residual(a, values, x)
    assert off < 1e-14 and skew < 1e-15
    assert np.abs(values - np.sort(want)[::-1]).max() < 1e-14
    if gap >= 1e-9:  # told apart, as far as the rounding of the matrix itself allows
        true = q[:, np.argsort(want)[::-1]].astype(float)
        away = np.minimum(np.abs(x - true).max(axis=0), np.abs(x + true).max(axis=0))
        assert away.max() < 1e-15 + 1e-19 / gap


def test_refinement_doubles_the_digits():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a = (a + a.T).astype(np.longdouble)
    a /= np.abs(a).max()
    _, x = np.linalg.eigh(a.astype(np.float32))
    changes = []
    for _ in range(4):
        x, _, change = whitening.refine(a, x)
        changes.append(change)
    assert changes[0] > 1e-8 and changes[1] < 1e-8 and changes[2] < 1e-14 and changes[3] < 1e-17
