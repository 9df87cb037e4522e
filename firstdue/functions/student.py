"""Student t distribution for one-row statistics tables.

Spark SQL has no incomplete beta or log-gamma function, so the few probabilities
a test needs are computed in a vectorised function over its result row.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TERMS = 400
TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    total = d
    for m in range(1, MAX_TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = 1.0 + step / c
            c = c if abs(c) > TINY else TINY
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def _beta_share(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float:
    """Probability of a value at least as far from 0 as ``t``."""
    if not (np.isfinite(t) and np.isfinite(df)) or df <= 0:
        return float("nan")
    return _beta_share(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(share: float, df: float) -> float:
    """Value that ``share`` (above one half) of the distribution lies below."""
    if not np.isfinite(df) or df <= 0:
        return float("nan")
    tail = 2.0 * (1.0 - share)
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if two_sided_p(mid, df) > tail else (low, mid)
    return (low + high) / 2.0


def _series(f, *columns: pd.Series) -> pd.Series:
    rows = zip(*[c.astype(float) for c in columns], strict=True)
    values = [f(*row) for row in rows]
    return pd.Series([None if np.isnan(v) else v for v in values], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(two_sided_p, t, df)


@F.pandas_udf(DoubleType())
def t_critical(share: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_quantile, share, df)
