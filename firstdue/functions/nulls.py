"""Expressions with the missing-value rules of a statistical data frame.

SQL and statistical data frames disagree on NULL in a few places; these helpers
give the data-frame answer where results depend on it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(test: Column, yes, no) -> Column:
    """``yes`` or ``no``, and NULL where the test itself is NULL."""
    return F.when(test, yes).when(~test, no)


def any_null(cols: Sequence[Column | str]) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).isNull() for c in cols])


def row_min(cols: Sequence[Column | str]) -> Column:
    """Smallest value of a row; NULL if any is NULL (``least`` would skip it)."""
    cols = [_col(c) for c in cols]
    smallest = F.least(*cols) if len(cols) > 1 else cols[0]
    return F.when(~any_null(cols), smallest)


def is_in(c: Column | str, values: Iterable) -> Column:
    """List membership that is FALSE, not NULL, for a missing value."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Iterable) -> Column:
    """Negated membership; a missing value is in no list, so it is kept."""
    return ~is_in(c, values)


def paste(*cols: Column | str, sep: str = " ") -> Column:
    """Concatenate as text, a missing value giving the letters ``NA``."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def na_policy(aggregate: Column, value: Column | str, na: str = "skip") -> Column:
    """``propagate`` turns an aggregate NULL as soon as one value is missing."""
    if na == "skip":
        return aggregate
    if na == "propagate":
        return F.when(F.count(F.lit(1)) == F.count(_col(value)), aggregate)
    raise ValueError(f"unknown na policy {na!r}")


def percent_change(before: Column | str, after: Column | str) -> Column:
    """(after - before) / before; NULL where ``before`` is 0."""
    before, after = _col(before), _col(after)
    return F.try_divide(after - before, before)
