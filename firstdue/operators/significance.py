"""p-values and confidence limits on top of the one-row test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.functions.student import t_critical, t_p_value


def with_welch_p_value(test: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Add p-value and confidence limits of the difference of means."""
    margin = t_critical(F.lit((1 + confidence) / 2), F.col("df")) * F.col("std_error")
    difference = F.col("mean1") - F.col("mean2")
    return test.withColumns(
        {
            "p_value": t_p_value(F.col("t"), F.col("df")),
            "conf_low": difference - margin,
            "conf_high": difference + margin,
        }
    )


def with_fit_p_values(fit: DataFrame) -> DataFrame:
    """Add the p-values of both coefficients of a fitted line."""
    df = (F.col("n") - 2).cast("double")
    return fit.withColumns(
        {
            "p_intercept": t_p_value(F.col("t_intercept"), df),
            "p_slope": t_p_value(F.col("t_slope"), df),
        }
    )
