"""Siting scenarios: best times, station differences, nearest station."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstdue.constants import CURRENT_SCENARIO, SCENARIOS, STATION_PAIRS
from firstdue.functions.nulls import any_null, row_min
from firstdue.operators.calibration import compare, time_column

TIE_TOLERANCE = 1e-5  # relative to the largest time of the row


def with_scenario_times(
    df: DataFrame,
    suffix: str = "",
    scaled: bool = True,
    scenarios: Mapping[str, Sequence[str]] = SCENARIOS,
) -> DataFrame:
    """Minutes of the nearest open station, one column per scenario."""
    return df.withColumns(
        {
            name: row_min([time_column(s, suffix, scaled) for s in stations])
            for name, stations in scenarios.items()
        }
    )


def with_station_differences(
    df: DataFrame,
    suffix: str = "",
    scaled: bool = True,
    pairs: Mapping[str, tuple[str, str]] = STATION_PAIRS,
) -> DataFrame:
    """Minutes of one station minus those of another."""
    return df.withColumns(
        {
            name: F.col(time_column(a, suffix, scaled)) - F.col(time_column(b, suffix, scaled))
            for name, (a, b) in pairs.items()
        }
    )


def nearest_station(
    stations: Sequence[str], suffix: str = "", scaled: bool = False
) -> Column:
    """Name of the nearest station; NULL as soon as one time is missing.

    Stations within the tie tolerance count as equally near, and the first one
    by name is taken.
    """
    columns = [F.col(time_column(s, suffix, scaled)) for s in stations]
    smallest = row_min(columns)
    largest = F.greatest(*[F.abs(c) for c in columns]) if len(columns) > 1 else F.abs(columns[0])
    names = F.array(
        *[
            F.when(c <= smallest + TIE_TOLERANCE * largest, F.lit(s))
            for s, c in zip(stations, columns, strict=True)
        ]
    )
    return F.when(~any_null(columns), F.array_min(names))


def with_nearest_stations(
    df: DataFrame,
    suffix: str = "",
    scaled: bool = False,
    scenarios: Sequence[str] = ("JW_and_FiveFifteen", "JW_and_Lowell", "Union_and_Lowell"),
) -> DataFrame:
    """Add ``station_<scenario>`` for each scenario."""
    return df.withColumns(
        {f"station_{s}": nearest_station(SCENARIOS[s], suffix, scaled) for s in scenarios}
    )


def nearest_station_share(df: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Rows and share per scenario and nearest station, in one pass over the rows."""
    labels = F.array(
        *[
            F.struct(F.lit(s).alias("scenario"), F.col(f"station_{s}").alias("station"))
            for s in scenarios
        ]
    )
    counted = df.select(F.inline(labels)).groupBy("scenario", "station").agg(
        F.count(F.lit(1)).alias("n")
    )
    of_scenario = Window.partitionBy("scenario")
    return counted.withColumn("share", F.col("n") / F.sum("n").over(of_scenario))


def with_calibrated_residual(
    df: DataFrame, actual: str = "first_resp", scenario: str = CURRENT_SCENARIO
) -> DataFrame:
    """Compare again on calibrated times; ``residual`` is the plain difference."""
    return compare(df, F.col(scenario), actual).withColumn(
        "residual", F.col(actual) - F.col(scenario)
    )
