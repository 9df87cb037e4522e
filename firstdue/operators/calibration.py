"""Predicted against actual minutes: comparison, fitted line, scaled times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.constants import (
    CURRENT_SCENARIO,
    LONG_TRIP_FACTOR,
    LONG_TRIP_MINUTES,
    SCALE_EPSILON,
    SCENARIOS,
    STATIONS,
    TIME_EPSILON,
    TRIM_DIFF,
    TRIM_RATIO,
)
from firstdue.functions.nulls import if_else, row_min


def time_column(station: str, suffix: str = "", scaled: bool = False) -> str:
    """Column of a station's minutes; ``suffix`` is ``_in_traffic`` or empty."""
    return f"from_{station}{suffix}" + ("_scaled" if scaled else "")


def compare(df: DataFrame, predicted: Column, actual: str = "first_resp") -> DataFrame:
    """Add actual, predicted, their difference and ratio.

    Both times get a small constant, so that a time of 0 does not divide by 0.
    """
    return df.withColumns(
        {"actual": F.col(actual) + TIME_EPSILON, "predicted": predicted + TIME_EPSILON}
    ).withColumns(
        {
            "diff": F.col("actual") - F.col("predicted"),
            "ratio": F.try_divide("actual", "predicted"),
        }
    )


def actual_vs_predicted(
    df: DataFrame,
    actual: str = "first_resp",
    suffix: str = "",
    stations: Sequence[str] = tuple(SCENARIOS[CURRENT_SCENARIO]),
) -> DataFrame:
    """Compare with the nearest of today's stations, times as predicted."""
    best = row_min([time_column(s, suffix) for s in stations])
    return compare(df, best, actual)


def trim_outliers(
    df: DataFrame,
    diff: tuple[float, float] = TRIM_DIFF,
    ratio: tuple[float, float] = TRIM_RATIO,
) -> DataFrame:
    """Keep rows whose difference and ratio lie strictly within the bounds."""
    d, r = F.col("diff"), F.col("ratio")
    return df.filter((d > diff[0]) & (d < diff[1])).filter((r > ratio[0]) & (r < ratio[1]))


def fit_line(df: DataFrame, y: str = "ratio", x: str = "predicted") -> DataFrame:
    """Least-squares line of ``y`` on ``x`` with its usual statistics, in one row."""
    y, x = F.col(y), F.col(x)
    sums = df.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("mx"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )
    n, sxx = F.col("n"), F.col("sxx")
    residual = F.try_divide(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), sxx), n - 2)
    return (
        sums.withColumn("residual_variance", residual)
        .withColumns(
            {
                "se_slope": F.sqrt(F.try_divide(F.col("residual_variance"), sxx)),
                "se_intercept": F.sqrt(
                    F.col("residual_variance")
                    * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.col("mx") * F.col("mx"), sxx))
                ),
            }
        )
        .withColumns(
            {
                "t_slope": F.try_divide("slope", "se_slope"),
                "t_intercept": F.try_divide("intercept", "se_intercept"),
            }
        )
        .select(
            "n", "slope", "intercept", "r2", "se_slope", "se_intercept", "t_slope",
            "t_intercept", (F.col("t_slope") * F.col("t_slope")).alias("f_statistic"),
            F.sqrt("residual_variance").alias("residual_se"),
        )
    )


def fit_calibration(df: DataFrame, actual: str = "first_resp", suffix: str = "") -> DataFrame:
    """How much the ratio falls with the predicted time, outliers left out."""
    return fit_line(trim_outliers(actual_vs_predicted(df, actual, suffix)))


def scale_time(minutes: Column, intercept: Column, slope: Column) -> Column:
    """Calibrated minutes: a fixed share of long trips, the line for the others."""
    by_line = (minutes + SCALE_EPSILON) * (intercept + slope * minutes)
    return if_else(minutes > LONG_TRIP_MINUTES, minutes * LONG_TRIP_FACTOR, by_line)


def with_calibrated_times(
    df: DataFrame,
    fit: DataFrame,
    suffix: str = "",
    stations: Sequence[str] = tuple(STATIONS),
) -> DataFrame:
    """Add ``from_<station>_scaled`` for every station.

    The line is one row; it enters as a scalar subquery, so no join is planned.
    """
    line = fit.select(F.struct("intercept", "slope"))
    rows = df.withColumn("__line", line.scalar())
    scaled = {
        time_column(s, suffix, scaled=True): scale_time(
            F.col(time_column(s, suffix)), F.col("__line.intercept"), F.col("__line.slope")
        )
        for s in stations
    }
    return rows.withColumns(scaled).drop("__line")


def ratio_without_outliers(
    df: DataFrame, predicted: str, actual: str = "first_resp", below: float = 3.0
) -> DataFrame:
    """Predicted over actual minutes where it stays below a bound."""
    ratio = F.try_divide(F.col(predicted), F.col(actual))
    return df.withColumn("diff", ratio).filter(F.col("diff") < below)
