"""Lloyd's rounds over whole-number vectors, with Ptolemy's inequality to skip comparisons.

For a vector q, a centroid c and two fixed pivots p and s, Ptolemy's inequality bounds their distance:

    d(q, c)  >=  | d(q, p) d(c, s) - d(q, s) d(c, p) | / d(p, s)

The distances from every vector to the pivots are computed once and stored beside it; those from
the few centroids are computed once a round. Every pair of pivots gives a bound, and the largest
counts. It is rounded down (``SLACK``), so a centroid is skipped only where it is certainly farther
than one already measured; all others are measured exactly, in whole numbers. The result is that of
measuring all, ties too.

A round is one pass: tasks assign their vectors and emit sums per centroid and dimension, Spark adds
them up, and the driver gets one row per centroid and dimension.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.llm.store import stored
from firstdue.llm.vectors import list_column, matrix, usable, whole_numbers

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
PIVOTS = 5  # ten pairs
#: Relative error of the bound's terms: three rounded roots, products, one difference.
SLACK = 16 * np.finfo(np.float64).eps
ROWS = 4096  # vectors compared at once


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``a`` to the row or rows ``b``, as long."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def choose_pivots(points: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` distinct points far from each other: each next one is farthest from those before."""
    chosen = points[:1]
    while len(chosen) and len(chosen) < count:
        away = np.min([squared(points, p) for p in chosen], axis=0)
        if away.max() == 0:
            break
        chosen = np.vstack([chosen, points[away.argmax()]])
    return chosen


def lower_bounds(to_pivots: np.ndarray, of_centroids: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distance of each row to each centroid, certainly not too high.

    ``to_pivots`` are the rows' distances to the pivots, ``of_centroids`` those of the centroids, and
    ``between`` those from pivot to pivot.
    """
    best = np.zeros((len(to_pivots), len(of_centroids)))
    for p, s in itertools.combinations(range(len(between)), 2):
        one = to_pivots[:, p, None] * of_centroids[None, :, s]
        two = to_pivots[:, s, None] * of_centroids[None, :, p]
        np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / between[p, s], out=best)
    return best * best * (1 - SLACK)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many were measured."""
    of_centroids = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(float))
    between = np.sqrt(np.stack([squared(pivots, p) for p in pivots], axis=1).astype(float))
    bounds = lower_bounds(to_pivots, of_centroids, between)
    # Start from the centroid that looks nearest; it settles most of the others.
    first = bounds.argmin(axis=1)
    label, distance = first.copy(), squared(x, centroids[first])
    measured = len(x)
    for c in range(len(centroids)):
        # A bound equal to the distance may be a tie.
        rows = np.flatnonzero((bounds[:, c] <= distance) & (first != c))
        if not len(rows):
            continue
        measured += len(rows)
        d = squared(x[rows], centroids[c])
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < label[rows]))
        label[rows[closer]], distance[rows[closer]] = c, d[closer]
    return label, distance, measured


def _pieces(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            cut = batch.slice(at, ROWS)
            yield cut, matrix(cut.column("x"), dims)


def _with_pivots(pivots: np.ndarray):
    def run(batches):
        for cut, x in _pieces(batches, pivots.shape[1]):
            away = np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(float))
            yield pa.RecordBatch.from_arrays(
                [cut.column("id"), cut.column("x"), list_column(away)], ["id", "x", "away"]
            )

    return run


def _assigned(pivots: np.ndarray, centroids: np.ndarray, batches):
    for cut, x in _pieces(batches, pivots.shape[1]):
        away = matrix(cut.column("away"), len(pivots))
        yield cut, x, *nearest(x, away, centroids, pivots)


def _sums(pivots: np.ndarray, centroids: np.ndarray):
    """One row per centroid and dimension that a task has met; dimension -1 counts vectors."""

    def run(batches):
        k, dims = centroids.shape
        total, measured = np.zeros((k, dims + 1), np.int64), 0
        for _, x, label, _, looked in _assigned(pivots, centroids, batches):
            measured += looked
            for c in np.unique(label):
                rows = x[label == c]
                total[c, 0] += len(rows)
                total[c, 1:] += rows.sum(axis=0)
        met = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.repeat(met, dims + 1), -1]),
                pa.array(np.r_[np.tile(np.arange(-1, dims), len(met)), 0]),
                pa.array(np.r_[total[met].ravel(), measured]),
            ],
            ["cluster", "dim", "total"],
        )

    return run


def _labels(pivots: np.ndarray, centroids: np.ndarray):
    def run(batches):
        for cut, _, label, distance, _ in _assigned(pivots, centroids, batches):
            yield pa.RecordBatch.from_arrays(
                [cut.column("id"), pa.array(label.astype(np.int32)), pa.array(distance)],
                ["id", "cluster", "distance"],
            )

    return run


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids after a round: exact floor of sum over count; those without vectors stay."""
    count, out = {}, centroids.copy()
    for cluster, dim, total in sums:
        if dim == -1:
            count[cluster] = total
    for cluster, dim, total in sums:
        if dim >= 0 and cluster >= 0:
            out[cluster, dim] = total // count[cluster]  # whole numbers of any size, rounded down
    return out


def cluster_vectors(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
    report: list | None = None,
) -> DataFrame:
    """``<vec_id>, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``dims`` finite entries; each entry becomes ``floor(scale * entry)``.
    Starts are the vectors with the smallest SHA-256 of ``1:<vec_id>`` (a missing id is empty text;
    equal hashes are settled by the vectors). Fewer vectors than ``centroids`` make as many centroids.
    Ties go to the smaller number, a centroid without vectors stays where it is. Repeated rows each
    count. Ids may have any type; no kept vector gives an empty table; other columns are ignored.
    Entries of 2**25 / ``scale`` or more fail with a message. ``report`` gets, per round, the
    distances measured and those there are.
    """
    spark = embeddings.sparkSession
    kept = embeddings.filter(usable(F.col(vector)) & (F.size(vector) == dims)).select(
        F.col(vec_id).alias("id"), whole_numbers(F.col(vector), scale).alias("x")
    )
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    # As many rows as there are centroids, whatever the input.
    start = kept.select("x", name.alias("name")).orderBy("name", "x").limit(centroids).collect()
    points = np.array([r.x for r in start], np.int64).reshape(-1, dims)
    kind = embeddings.schema[vec_id].dataType.simpleString()
    if not len(points):
        return spark.createDataFrame(
            [], f"`{vec_id}` {kind}, cluster int, distance long, cluster_inertia long, "
            "inertia long, centroid_sha256 string"
        )
    pivots = choose_pivots(points)
    ready = stored(
        kept.mapInArrow(_with_pivots(pivots), f"id {kind}, x array<int>, away array<double>"), "pivoted"
    )
    for _ in range(rounds):
        sums = ready.mapInArrow(_sums(pivots, points), "cluster long, dim long, total long")
        found = sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()
        if report is not None:
            counts = [r.total for r in found if r.dim == -1]
            report.append((next(r.total for r in found if r.cluster == -1), sum(counts) * len(points)))
        points = moved(points, found)
    labelled = stored(
        ready.mapInArrow(_labels(pivots, points), f"id {kind}, cluster int, distance long"), "clusters"
    )
    per = labelled.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = [
        (c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points.tolist())
    ]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    inertia = per.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row per centroid.
    about = per.join(F.broadcast(named), "cluster").withColumn("inertia", inertia.scalar())
    return labelled.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
