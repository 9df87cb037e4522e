"""Response-time indicators by unit and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.functions.nulls import percent_change
from firstdue.operators.quantiles import group_quantiles


def critical_first_responses(
    responses: DataFrame,
    natures: Sequence[str],
    units: Sequence[str] | None = None,
    below_minutes: float | None = None,
) -> DataFrame:
    """Responses of first units to critical calls."""
    rows = responses.filter(F.col("nature").isin(list(natures)) & (F.col("is_first") == 1))
    if units is not None:
        rows = rows.filter(F.col("unit").isin(list(units)))
    if below_minutes is not None:
        rows = rows.filter(F.col("first_resp") < below_minutes)
    return rows


def spread_years(
    df: DataFrame,
    value: str,
    years: Sequence[str],
    before: str,
    after: str,
    key: str | None = "unit",
    year: str = "year",
) -> DataFrame:
    """One column per year (``y_<year>``) and the change between two of them."""
    keys = [key] if key else []
    wide = df.groupBy(*keys).pivot(year, list(years)).agg(F.first(value))
    wide = wide.withColumnsRenamed({y: f"y_{y}" for y in years})
    return wide.withColumn("per_change", percent_change(f"y_{before}", f"y_{after}"))


def quantile_by_unit_year(
    rows: DataFrame,
    p: float,
    years: Sequence[str],
    before: str,
    after: str,
    value: str = "first_resp",
) -> DataFrame:
    """A quantile of minutes per unit, one column per year; blank units dropped."""
    named = rows.filter(F.col("unit") != "")
    found = group_quantiles(named, ["unit", "year"], value, {"m": p})
    return spread_years(found, "m", years, before, after)


def quantile_by_year(
    rows: DataFrame,
    p: float,
    years: Sequence[str],
    before: str,
    after: str,
    value: str = "first_resp",
) -> DataFrame:
    """A quantile of minutes per year, in one row."""
    found = group_quantiles(rows, ["year"], value, {"m": p})
    return spread_years(found, "m", years, before, after, key=None)


def avg_runs_per_day(
    responses: DataFrame, years: Sequence[str], before: str, after: str, training: str
) -> DataFrame:
    """Mean runs per unit over the days that have runs, one column per year.

    A run is a distinct (incident, unit, day). Sorted by the last year, missing last.
    """
    runs = (
        responses.filter((F.col("nature") != training) & (F.col("unit") != ""))
        .groupBy("incident_id", "unit", "date_short")
        .agg(F.min("year").alias("year"))
    )
    per_day = runs.groupBy("unit", "year", "date_short").agg(F.count(F.lit(1)).alias("n"))
    mean = per_day.groupBy("unit", "year").agg(F.avg("n").alias("m"))
    wide = spread_years(mean, "m", years, before, after)
    return wide.orderBy(F.col(f"y_{after}").desc_nulls_last(), "unit")


def exceedance_share(rows: DataFrame, limit: float = 5.0, value: str = "first_resp") -> DataFrame:
    """Share of responses above ``limit`` per year; years without one do not appear."""
    return (
        rows.groupBy("year")
        .agg(F.count_if(F.col(value) > limit).alias("n"), F.count(F.lit(1)).alias("n_all"))
        .filter(F.col("n") > 0)
        .withColumn("share", F.col("n") / F.col("n_all"))
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, key: str, k: int = 80) -> DataFrame:
    """The ``k`` most frequent values, ties in order of the value."""
    return count_by(df, key).orderBy(F.col("n").desc(), F.col(key).asc_nulls_last()).limit(k)
