"""Two-dimensional kernel density on a fixed grid of nodes.

Rows are first counted per distinct point. A kernel of two axes is a product of one
per axis, so each task works out one kernel row per distinct longitude and one per
distinct latitude, multiplies them through the sparse matrix of counts between
them, and emits one row per node, which Spark sums over tasks. The product is exact,
its memory is the grid's, and no (point, node) pairs are shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firstdue.constants import DENSITY_BANDS
from firstdue.operators.quantiles import group_quantiles

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KERNEL_ROWS = 4096  # points per matrix product
HELD_FACETS = 64  # grids a task keeps before it emits them


def point_counts(rows: DataFrame, facet: str | None = None) -> DataFrame:
    """Rows per distinct point (and facet)."""
    keys = [facet] if facet else []
    return (
        rows.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .groupBy(*keys, "lon", "lat")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table on every row, as a scalar subquery."""
    values = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("__one", values).select(*df.columns, "__one.*")


def _span(points: DataFrame) -> DataFrame:
    return points.agg(
        F.min("lon").alias("x0"), F.max("lon").alias("x1"),
        F.min("lat").alias("y0"), F.max("lat").alias("y1"),
    )


def bandwidths(points: DataFrame, facet: str | None = None) -> DataFrame:
    """``n``, the kernel width of each axis (``sx``, ``sy``) and the span of all data, per facet.

    Width: 1.06 · min(sd, IQR / 1.34) · n^(-1/5). Fails where a width is not positive, as
    for a single point or when half of the rows share a coordinate: there is no density.
    Both axes are one table of counts per distinct coordinate, which gives quartiles and spread at once.
    """
    keys = [facet] if facet else []
    span = _span(points)
    # Above the lowest point, so that no digits cancel.
    above = {a: F.col(c) - F.col(f"{a}0") for a, c in (("x", "lon"), ("y", "lat"))}
    axes = F.array(*[F.struct(F.lit(a).alias("__axis"), v.alias("__v")) for a, v in above.items()])
    long = _attach(points, span).select(*keys, "c", F.inline(axes))
    found = group_quantiles(
        long, [*keys, "__axis"], "__v", {"q1": 0.25, "q3": 0.75}, {"n": "rows", "var": "variance"}, weight="c"
    )
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    width = 1.06 * F.least(F.sqrt("var"), iqr) * F.pow(F.col("n"), F.lit(-0.2))
    # One point has no spread at all.
    message = F.concat(F.lit("no density: the kernel width of axis "), "__axis", F.lit(" is not positive"))
    checked = F.when((width > 0) & (F.col("n") > 1), width).otherwise(F.raise_error(message))
    wide = found.withColumn("s", checked).groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("__axis") == a, F.col("s"))).alias(f"s{a}") for a in "xy"]
    )
    return _attach(wide, span) if facet else _attach(wide.filter("n > 0"), span)


def _by_facet(rows: DataFrame, table: DataFrame, facet: str) -> DataFrame:
    """Join a table with one row per facet, where a missing facet is one like any other."""
    named = table.withColumnRenamed(facet, "__f")
    return rows.join(named, rows[facet].eqNullSafe(named["__f"])).drop("__f")


def _kernels(nodes: np.ndarray, x: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """One kernel row per distinct ``x``, and which of them each ``x`` has."""
    own, which = np.unique(x, return_inverse=True)
    z = (nodes[None, :] - own[:, None]) / width
    return np.exp(-0.5 * z * z) / np.sqrt(2.0 * np.pi), which


def _grid_part(gx, gy, lon, lat, weight, sx, sy) -> np.ndarray:
    """The points' kernels on the grid: kernels of longitudes, counts, kernels of latitudes.

    The counts are a sparse matrix between distinct longitudes and latitudes, one entry per point.
    """
    kx, ix = _kernels(gx, lon, sx)
    ky, iy = _kernels(gy, lat, sy)
    order = np.argsort(ix, kind="stable")
    starts = np.flatnonzero(np.diff(ix[order], prepend=-1))
    rows = np.add.reduceat(ky[iy[order]] * weight[order, None], starts, axis=0)
    return kx.T @ rows


def _grid_sums(size: int):
    """Batches of points in, one row per facet and node out."""

    def rows_of(held: dict) -> Iterator[pd.DataFrame]:
        for facet, (gx, gy, grid) in held.items():
            ix, iy = np.divmod(np.arange(size * size), size)
            yield pd.DataFrame(
                {"facet": facet, "ix": ix, "iy": iy, "lon": gx[ix], "lat": gy[iy],
                 "density": grid.ravel()}
            )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for facet, part in batch.groupby("facet", sort=False):
                p = part.iloc[0]
                if facet not in held:
                    gx = np.linspace(p.x0, p.x1, size)
                    gy = np.linspace(p.y0, p.y1, size)
                    held[facet] = (gx, gy, np.zeros((size, size)))
                gx, gy, grid = held[facet]
                scale = p.n * p.sx * p.sy
                lon, lat = part["lon"].to_numpy(), part["lat"].to_numpy()
                weight = part["c"].to_numpy() / scale
                for at in range(0, len(part), KERNEL_ROWS):
                    cut = slice(at, at + KERNEL_ROWS)
                    grid += _grid_part(gx, gy, lon[cut], lat[cut], weight[cut], p.sx, p.sy)
            if len(held) > HELD_FACETS:
                yield from rows_of(held)
                held = {}
        yield from rows_of(held)

    return run


def density_grid(
    rows: DataFrame, size: int = 100, facet: str | None = None
) -> DataFrame:
    """Density at ``size`` × ``size`` nodes spanning the data.

    With ``facet`` each value has its own bandwidth, a missing one too; all share the same
    nodes. No rows give no density; see ``bandwidths`` for rows without spread.
    """
    points = point_counts(rows, facet)
    widths = bandwidths(points, facet)
    placed = _by_facet(points, widths, facet) if facet else _attach(points, widths)
    # As text on the way: blank for a missing facet, else marked. Equal longitudes come together.
    text = F.concat(F.lit("="), F.col(facet).cast("string")) if facet else F.lit("")
    placed = placed.select(
        F.coalesce(text, F.lit("")).alias("facet"),
        "lon", "lat", "c", "n", "sx", "sy", "x0", "x1", "y0", "y1",
    ).sortWithinPartitions("facet", "lon")
    sums = placed.mapInPandas(
        _grid_sums(size), "facet string, ix int, iy int, lon double, lat double, density double"
    )
    out = sums.groupBy("facet", "ix", "iy").agg(
        F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.sum("density").alias("density")
    )
    if not facet:
        return out.drop("facet")
    value = F.when(F.col("facet") != "", F.substring("facet", 2, 2**31 - 1))
    own = value.cast(rows.schema[facet].dataType).alias(facet)
    return out.select(own, *[c for c in out.columns if c != "facet"])


def density_bands(
    grid: DataFrame, bands: int = DENSITY_BANDS, facet: str | None = None
) -> DataFrame:
    """Add the band 1 … ``bands`` of equal width up to the highest density.

    The window covers one facet's nodes, whose number is fixed.
    """
    top = F.max("density").over(Window.partitionBy(*([facet] if facet else [])))
    share = F.try_divide(F.col("density"), top)
    band = F.least(F.lit(bands), F.floor(share * bands) + 1)
    return grid.withColumn("band", band.cast("int"))
