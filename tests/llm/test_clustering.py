"""Clusters against a plain Python version, and the bound itself."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from firstdue.llm import clustering

ROWS = "vec_id long, embedding array<float>, id string, x map<string,int>"


def plain(rows, dims, k, rounds):
    kept = [
        (i, [math.floor(clustering.SCALE * float(c)) for c in v]) for i, v in rows
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)
    ]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    points = [x for _, x in sorted(((name(i), x) for i, x in kept))][:k]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, p, strict=True)) for p in points]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(points)):
            own = [x for (_, x), (label, _) in zip(kept, got, strict=True) if label == c]
            if own:
                points[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = assign()
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(
        (
            (i, c, d, sum(e for b, e in got if b == c), sum(e for _, e in got), sha[c])
            for (i, _), (c, d) in zip(kept, got, strict=True)
        ),
        key=repr,
    )


def run(spark, rows, dims, k, rounds, report=None):
    df = spark.createDataFrame([(i, v, "a", {"b": 1}) for i, v in rows], ROWS).repartition(5)
    got = clustering.cluster_vectors(df, dims=dims, centroids=k, rounds=rounds, report=report)
    assert got.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ]
    return sorted(map(tuple, got.collect()), key=repr)


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(7)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in centres[i % 7]]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(1000, 1400)]  # one common vector
    report = []
    assert run(spark, rows, 8, 16, 3, report) == plain(rows, 8, 16, 3)
    assert len(report) == 3 and all(all_ == 1100 * 16 for _, all_ in report)
    assert all(measured < 0.6 * all_ for measured, all_ in report)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, [1.0]), (3, [1.0, float("nan")]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [])],
    [(1, [1.0, 2.0])],
    [(None, [0.5, 0.5]), (None, [0.25, 0.5]), (7, [-0.01, 0.0]), (7, [-0.01, 0.0])],
    [(i, [1.0, 1.0]) for i in range(30)],  # one point: no two pivots
    [(i, [float(i % 3), 0.0]) for i in range(40)],  # ties
])
def test_odd_tables(spark, rows):
    assert run(spark, rows, 2, 4, 3) == plain(rows, 2, 4, 3)


def test_text_ids_and_large_entries(spark):
    df = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [1.0, 2.5])], "k string, v array<double>")
    got = clustering.cluster_vectors(df, "k", "v", dims=2)
    assert sorted(r.k for r in got.collect()) == ["a", "b"]
    large = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="must stay below"):
        clustering.cluster_vectors(large, dims=2)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 2**25 - 1), st.integers(0, 2**32 - 1), st.integers(2, 9))
def test_bounds_never_exceed_the_distance(size, seed, dims):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, (30, dims))
    x[:5] = x[5:10] + rng.integers(-1, 2, (5, dims))  # near and equal points
    centroids, pivots = x[:8], clustering.choose_pivots(x, 5)
    away = np.sqrt(np.stack([clustering.squared(x, p) for p in pivots], 1).astype(float))
    label, distance, _ = clustering.nearest(x, away, centroids, pivots)
    every = np.stack([clustering.squared(x, c) for c in centroids], 1)
    assert (label == every.argmin(1)).all() and (distance == every.min(1)).all()
    of = np.sqrt(np.stack([clustering.squared(centroids, p) for p in pivots], 1).astype(float))
    between = np.sqrt(np.stack([clustering.squared(pivots, p) for p in pivots], 1).astype(float))
    assert (clustering.lower_bounds(away, of, between) <= every).all()
