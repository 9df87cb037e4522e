"""Whitening of embeddings: refined eigenvectors of a covariance that Spark adds up exactly.

Vectors become whole numbers, and each distinct one is counted once. Two passes over these give the
covariance without rounding: sums per dimension, then products of the vectors less the whole-number part
of their mean. Tasks emit one row per pair of dimensions, Spark adds them up, and only these sums
(their number is the square of the dimension) come to the driver.

There the eigenvectors are found in float32 and refined by the matrix-multiplication iteration of Ogita and
Aishima in extended precision, which doubles the right digits at each step. Where eigenvalues lie so
close that the step would divide by their difference, the vectors of the cluster are first turned among
themselves by the eigenvectors of the small shifted matrix they span; once these are told apart the
iteration goes on with all of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.llm.store import stored
from firstdue.llm.vectors import matrix, usable, whole_numbers

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, COMPONENTS = 256, 4
STEPS = 8  # refinements at most; three or four are usual
ROWS = 4096  # vectors multiplied at once
EXACT = 2**53  # whole numbers below this are exact in a double
HIGH = np.longdouble
WHOLE = pa.decimal128(38, 0)


# ---- eigenvectors ---------------------------------------------------------------------------


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: better eigenvectors of symmetric ``a``, their eigenvalues, and the size of the change."""
    n = len(a)
    x = x.astype(HIGH)
    r = np.eye(n, dtype=HIGH) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding, divided by a small gap, would skew the vectors
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    size = np.sqrt((a * a).sum())
    rounding = 4 * n * np.finfo(HIGH).eps
    close = 2 * (np.sqrt((off * off).sum()) + size * (np.sqrt((r * r).sum()) + rounding))
    # Columns in order of their eigenvalues; runs of close neighbours are clusters.
    order = np.argsort(values, kind="stable")[::-1]
    x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
    gap = values[None, :] - values[:, None]
    cluster = np.r_[0, np.cumsum(values[:-1] - values[1:] > close)]
    same = cluster[:, None] == cluster[None, :]
    e = np.where(same, r / 2, (s + values[None, :] * r) / np.where(same, 1, gap))
    x = x + x @ e
    for c in np.flatnonzero(np.bincount(cluster) > 1):
        x[:, cluster == c] = _sub_solve(a, x[:, cluster == c])
    return x, values, float(np.abs(e).max())


def _sub_solve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Vectors that span what ``x`` spans, turned to the eigenvectors of ``a`` within it.

    The mean eigenvalue is taken off first, so that what is left of ``a`` is as small as the cluster is
    wide, and rounding is small against the differences.
    """
    shift = (np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)).mean()
    small = x.T @ (a @ x - shift * x)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if size == 0:
        return x
    _, turn = np.linalg.eigh((small / size).astype(np.float64))
    return x @ turn[:, ::-1].astype(HIGH)


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of symmetric ``a``, falling, and unit eigenvectors in its columns, as doubles.

    ``a`` may be in extended precision. Equal eigenvalues get any orthonormal vectors of their space.
    """
    a = np.asarray(a, dtype=HIGH)
    size = np.abs(a).max() if a.size else 0
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    _, x = np.linalg.eigh(a.astype(np.float32))
    for _ in range(STEPS):
        x, _, change = refine(a, x)
        if change <= 16 * len(a) * np.finfo(HIGH).eps:
            break
    x = x @ (3 * np.eye(len(a), dtype=HIGH) - x.T @ x) / 2  # what rounding over gaps has skewed
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(values, kind="stable")[::-1]
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


# ---- sums -----------------------------------------------------------------------------------


def _batches(batches: Iterator[pa.RecordBatch], dims: int, rows: int = ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            cut = batch.slice(at, rows)
            yield cut, matrix(cut.column("x"), dims)


def _sum_rows(i, j, total) -> pa.RecordBatch:
    totals = pa.array([Decimal(int(t)) for t in total], WHOLE)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(i, np.int32)), pa.array(np.asarray(j, np.int32)), totals], ["i", "j", "total"]
    )


def _first_sums(dims: int):
    """Sums per dimension; dimension -1 counts vectors."""

    def run(batches):
        count, total = 0, np.zeros(dims, object)
        for _, x in _batches(batches, dims):
            count += len(x)
            total += x.sum(axis=0).astype(object)  # a batch's sum fits a long
        yield _sum_rows([-1, *range(dims)], [0] * (dims + 1), [count, *total])

    return run


def _products(centre: np.ndarray):
    """Sums of products of the centred entries, per pair of dimensions."""
    dims = len(centre)
    i, j = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((dims, dims), object)
        for _, x in _batches(batches, dims):
            y = (x - centre).astype(np.float64)
            # As many rows at once as a double adds up exactly.
            rows = max(1, int(EXACT // max(1.0, float(np.abs(y).max(initial=0)) ** 2)))
            for at in range(0, len(y), rows):
                part = y[at : at + rows]
                total += (part.T @ part).astype(np.int64).astype(object)
        yield _sum_rows(i, j, total[i, j])

    return run


def _collected(sums: DataFrame) -> dict:
    found = sums.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    return {(r.i, r.j): int(r.total or 0) for r in found}


def covariance(distinct: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums per dimension and the covariance (divisor n) of ``x``.

    Exact but for the last rounding, to extended precision.
    """
    kind = "i int, j int, total decimal(38,0)"
    first = _collected(distinct.mapInArrow(_first_sums(dims), kind))
    n, sums = first.get((-1, 0), 0), [first.get((k, 0), 0) for k in range(dims)]
    if not n:
        return 0, sums, np.zeros((dims, dims), HIGH)
    centre = np.array([s // n for s in sums], np.int64)
    products = _collected(distinct.mapInArrow(_products(centre), kind))
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    out = np.zeros((dims, dims), HIGH)
    for (i, j), total in products.items():
        out[i, j] = out[j, i] = _high(Fraction(n * total - rest[i] * rest[j], n * n))
    return n, sums, out


def _high(value: Fraction) -> np.floating:
    head = float(value)
    return HIGH(head) + HIGH(float(value - Fraction(head)))


# ---- whitening ------------------------------------------------------------------------------


class Whitener:
    """Mean, directions and scale that a fit has found; what tasks apply to vectors."""

    def __init__(self, n: int, sums: list[int], cov: np.ndarray, components: int):
        values, vectors = eigenvectors(cov)
        trace = float(np.trace(cov))
        self.n, self.sums, self.dims = n, sums, len(sums)
        self.vectors, self.values = vectors[:, :components], values[:components]
        # A direction without spread, but for rounding, has no scale.
        self.spread = self.values > len(cov) * np.finfo(np.float64).eps * max(trace, 0.0)
        self.explained = self.values / trace if trace > 0 else np.full(len(self.values), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: as long where that is large enough, else as Python's whole numbers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, self.dims) < 2**63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.spread, self.values, 1.0))
        return (centred.astype(np.float64) / self.n) @ self.vectors / scale


def _moments(white: Whitener):
    """Sums of whitened components and of their products, as one row per task and pair."""
    k = int(white.spread.sum())
    i, j = np.triu_indices(k)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _batches(batches, white.dims):
            w = white.whitened(white.centred(x))[:, white.spread]
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.full(k, -1), i].astype(np.int32)),
                pa.array(np.r_[np.arange(k), j].astype(np.int32)),
                pa.array(np.r_[first, second[i, j]]),
            ],
            ["i", "j", "total"],
        )

    return run


def identity_error(distinct: DataFrame, white: Whitener) -> float:
    """Largest entry of the whitened fit rows' covariance less the identity, from the rows themselves.

    The whitened rows are centred already; what is left of their mean is taken off all the same.
    """
    sums = distinct.mapInArrow(_moments(white), "i int, j int, total double")
    found = {(r.i, r.j): r.total for r in sums.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    mean = {j: t / white.n for (i, j), t in found.items() if i == -1}
    return max(
        (abs(t / white.n - mean[i] * mean[j] - (i == j)) for (i, j), t in found.items() if i >= 0), default=0.0
    )


def _rows(white: Whitener, error: float):
    """One row per vector and component."""

    def run(batches):
        for cut, x in _batches(batches, white.dims):
            d, k = white.centred(x), len(white.values)
            squares = (d * d).sum(axis=1)
            deviation = [int(s) if s < 2**63 else None for s in squares.tolist()]
            w = white.whitened(d)
            none = np.tile(~white.spread, len(w))
            which = pa.array(np.repeat(np.arange(len(w)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    cut.column("id").take(which),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                    pa.array(np.full(len(w) * k, white.n)),
                    pa.array(deviation, pa.int64()).take(which),
                    pa.array(w.ravel(), mask=none),
                    pa.array(np.tile(white.explained, len(w)), from_pandas=True),
                    pa.array(np.full(len(w) * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    components: int = COMPONENTS, scale: int = SCALE,
) -> DataFrame:
    """``<vec_id>, component, n, deviation, whitened, explained, identity_error`` per vector and component.

    Rows whose vector is missing or has an entry that is missing or not finite are left out; every other
    entry becomes ``floor(scale * entry)``. The fit takes each distinct vector once. A vector shorter than
    the longest counts as ending in zeros. Directions without spread (fewer distinct vectors than
    components, dimensions that depend on each other) have no whitened value (null), and ``explained`` is
    null where nothing spreads. ``deviation`` is null where it exceeds a long. Repeated rows each get their
    rows, ids may have any type, other columns are ignored, and an empty table gives an empty one.
    Entries of 2**25 / ``scale`` or more fail with a message.
    """
    kept = embeddings.filter(usable(F.col(vector))).select(
        F.col(vec_id).alias("id"), whole_numbers(F.col(vector), scale).alias("x")
    )
    kept = stored(kept, "whole-vectors")
    distinct = stored(kept.select("x").distinct(), "distinct-vectors")
    dims = distinct.agg(F.max(F.size("x"))).collect()[0][0] or 0
    n, sums, cov = covariance(distinct, dims)
    white = Whitener(n, sums, cov, min(components, dims))
    kind = embeddings.schema[vec_id].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    error = identity_error(distinct, white) if n and dims else 0.0
    return kept.mapInArrow(_rows(white, error), schema).withColumnRenamed("id", vec_id)
