"""Station siting on whole tables: calibrate, build scenarios, find nearest stations.

Drive times belong to addresses, of which there are far fewer than responses.
Everything that follows from them alone is computed on the station-by-address
matrix, one row per address, and joined to the responses once at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from firstdue.constants import STATIONS
from firstdue.operators.calibration import fit_calibration, with_calibrated_times
from firstdue.operators.drive_times import drive_time_matrix
from firstdue.operators.joins import lookup_join
from firstdue.operators.scenarios import (
    with_calibrated_residual,
    with_nearest_stations,
    with_scenario_times,
    with_station_differences,
)


def siting_table(
    rows: DataFrame,
    times: DataFrame,
    key: str = "full_address",
    stations: Sequence[str] = tuple(STATIONS),
    suffix: str = "",
    actual: str = "first_resp",
) -> DataFrame:
    """Responses with scaled, scenario and difference times of their address.

    ``suffix`` is ``_in_traffic`` for the times in traffic. The line is fitted on
    all responses that have drive times.
    """
    matrix = drive_time_matrix(times, key, stations, traffic=bool(suffix))
    fit = fit_calibration(lookup_join(rows, matrix, key, "inner"), actual, suffix)
    matrix = with_calibrated_times(matrix, fit, suffix, stations)
    matrix = with_station_differences(with_scenario_times(matrix, suffix), suffix)
    return with_calibrated_residual(lookup_join(rows, matrix, key, "inner"), actual)


def nearest_station_table(
    rows: DataFrame,
    times: DataFrame,
    key: str = "full_address",
    stations: Sequence[str] = tuple(STATIONS),
    suffix: str = "",
) -> DataFrame:
    """Responses with the nearest station of their address in each scenario."""
    matrix = drive_time_matrix(times, key, stations, traffic=bool(suffix))
    return lookup_join(rows, with_nearest_stations(matrix, suffix), key, "inner")
