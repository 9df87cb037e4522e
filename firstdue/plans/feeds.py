"""Per-address tables behind the maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.functions.labels import minutes_band, under_limit


def address_means(
    rows: DataFrame,
    values: Sequence[str],
    address: Sequence[str] = ("full_address",),
    order: Sequence[str] = ("incident_id",),
    unit: str | None = None,
) -> DataFrame:
    """Rows, means and first point per address, optionally of one unit.

    The first point is the one of the lowest ``order``; among equal ones, or one with a missing
    coordinate, the lowest point that has both. All aggregates combine
    before the shuffle, so an address with very many calls stays one row per task.
    """
    if unit is not None:
        rows = rows.filter(F.col("unit") == unit)
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    first = F.struct(*order, "lon", "lat")
    return rows.groupBy(*address).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(v).alias(v) for v in values],
        F.min(F.when(placed, first)).alias("__first"),
    ).select(
        *address, "n", *values, F.col("__first.lon").alias("lon"), F.col("__first.lat").alias("lat")
    )


def faster_flag(difference: Column | str) -> Column:
    """Is the first station of a difference the faster one?"""
    c = F.col(difference) if isinstance(difference, str) else difference
    return under_limit(c, 0.0)


def scenario_map(rows: DataFrame, scenario: str, **grouping) -> DataFrame:
    """Mean minutes of a scenario per address, with flag and band."""
    return address_means(rows, [scenario], **grouping).withColumns(
        {
            "under_five": under_limit(F.col(scenario)),
            "band": minutes_band(F.col(scenario)),
        }
    )


def actual_map(rows: DataFrame, actual: str = "first_resp", **grouping) -> DataFrame:
    """Mean actual minutes per address, with flag."""
    return address_means(rows, [actual], **grouping).withColumn(
        "under_five", under_limit(F.col(actual))
    )


def difference_map(rows: DataFrame, difference: str, unit: str | None = None, **grouping):
    """Mean difference of two stations per address, with the faster-flag."""
    return address_means(rows, [difference], unit=unit, **grouping).withColumn(
        "faster", faster_flag(difference)
    )


def raw_time_map(rows: DataFrame, column: str, unit: str, **grouping) -> DataFrame:
    """Mean uncalibrated minutes from one station to the calls of a unit."""
    return address_means(rows, [column], unit=unit, **grouping).withColumn(
        "under_five", under_limit(F.col(column))
    )


def nearest_map(
    rows: DataFrame, scenarios: Sequence[str], keys: Sequence[str] = ("incident_id",)
) -> DataFrame:
    """One point per row with its nearest station in each scenario."""
    return rows.select(*keys, "lon", "lat", *[f"station_{s}" for s in scenarios])
