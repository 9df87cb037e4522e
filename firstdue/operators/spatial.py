"""Point tables and grids for maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.constants import CELL_DEGREES
from firstdue.functions.labels import bad_geocode
from firstdue.operators.quantiles import group_quantiles

EDGE = 1e-8  # of a cell's width


def mappable(
    responses: DataFrame,
    natures: list[str],
    bad_addresses: list[str],
    first_only: bool = False,
    over_minutes: float | None = None,
    without_year: str | None = None,
    only_year: str | None = None,
) -> DataFrame:
    """Responses to critical calls at a well placed address."""
    good = bad_geocode(F.col("full_address"), F.col("lat"), F.col("lon"), bad_addresses) == 0
    rows = responses.filter(F.col("nature").isin(natures) & good & F.col("lon").isNotNull())
    if first_only:
        rows = rows.filter(F.col("is_first") == 1)
    if over_minutes is not None:
        rows = rows.filter(F.col("first_resp") > over_minutes)
    if without_year is not None:
        rows = rows.filter(F.col("year") != without_year)
    if only_year is not None:
        rows = rows.filter(F.col("year") == only_year)
    return rows


def incident_points(rows: DataFrame, incident: str = "incident_id") -> DataFrame:
    """One point per incident; smallest longitude and latitude independently."""
    return (
        rows.groupBy(incident)
        .agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), F.min("year").alias("year"))
        .filter(F.col("lon").isNotNull())
    )


def dot_points(rows: DataFrame, value: str = "first_resp") -> DataFrame:
    """Rows and median of ``value`` per exact coordinate."""
    return group_quantiles(rows, ["lon", "lat"], value, {"median": 0.5}, {"n": "rows"})


def cell_number(x: Column, width: float) -> Column:
    """Number of the right-closed cell.

    A value within 1e-8 of a width of an edge lies on it: the division leaves that much.
    """
    return F.ceil(x / width - EDGE) - 1


def grid_statistics(
    rows: DataFrame,
    stats: Mapping[str, str | float],
    facets: Sequence[str | None] = (None,),
    value: str = "first_resp",
    width: float = CELL_DEGREES,
    closed_lowest: bool = True,
) -> DataFrame:
    """Several statistics of ``value`` per cell, and per cell and facet, from one pass over ``rows``.

    ``stats`` names the output columns, each "mean", "median" or a quantile share. Every entry of
    ``facets`` is a grid of its own: None for the cells alone, or a column that splits them. ``grid`` tells
    which one a row belongs to ("all" or that column); facet columns of other grids are null. Rows are
    counted once per cell, facet and value; all grids, statistics and the lowest edge come from
    these counts. ``closed_lowest`` puts a point exactly on the lowest edge of all data into the first cell.
    A missing coordinate is a cell of its own; missing and NaN values count in ``n`` only.
    """
    split = list(dict.fromkeys(f for f in facets if f))
    counted = rows.groupBy(
        *split, cell_number(F.col("lon"), width).alias("cell_x"),
        cell_number(F.col("lat"), width).alias("cell_y"), F.col(value).cast("double").alias("__x"),
    ).agg(F.count(F.lit(1)).alias("__c"), F.min("lon").alias("__lon"), F.min("lat").alias("__lat"))
    if closed_lowest:
        edge = counted.agg(F.struct(F.min("__lon").alias("x"), F.min("__lat").alias("y"))).scalar()
        lowest = lambda axis: F.floor(F.col("__edge")[axis] / width + EDGE)
        moved = {
            f"cell_{a}": F.when(F.col(f"cell_{a}").isNotNull(), F.greatest(f"cell_{a}", lowest(a)))
            for a in ("x", "y")
        }
        counted = counted.withColumn("__edge", edge).withColumns(moved)
    grids = F.array(
        *[
            F.struct(
                F.lit(f or "all").alias("grid"),
                *[(F.col(c) if c == f else F.lit(None)).alias(f"__f_{c}") for c in split],
            )
            for f in dict.fromkeys(facets)
        ]
    )
    cells = counted.select("cell_x", "cell_y", "__x", "__c", F.inline(grids)).withColumnsRenamed(
        {f"__f_{c}": c for c in split}
    )
    keys = ["grid", *split, "cell_x", "cell_y"]
    shares = {name: 0.5 if s == "median" else float(s) for name, s in stats.items() if s != "mean"}
    means = {name: "mean" for name, s in stats.items() if s == "mean"}
    if shares:
        out = group_quantiles(cells, keys, "__x", shares, {**means, "n": "rows"}, weight="__c")
    else:
        known = F.col("__x").isNotNull() & ~F.isnan("__x")
        mean = F.try_divide(
            F.sum(F.when(known, F.col("__x") * F.col("__c"))), F.sum(F.when(known, F.col("__c")))
        )
        out = cells.groupBy(*keys).agg(*[mean.alias(m) for m in means], F.sum("__c").alias("n"))
    return out.select(*keys, *stats, "n").withColumns(
        {
            "lon": (F.col("cell_x") + 0.5) * width,
            "lat": (F.col("cell_y") + 0.5) * width,
        }
    )


def grid_summary(
    rows: DataFrame,
    stat: str | float = "mean",
    value: str = "first_resp",
    facet: str | None = None,
    width: float = CELL_DEGREES,
    closed_lowest: bool = True,
) -> DataFrame:
    """One statistic of ``value`` per cell (and facet), as ``stat``; see ``grid_statistics``."""
    return grid_statistics(rows, {"stat": stat}, [facet], value, width, closed_lowest).drop("grid")
