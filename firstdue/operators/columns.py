"""Column selection, natural join and append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last``, both included, in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def select_range(df: DataFrame, first: str, last: str, keep: list[str] | None = None) -> DataFrame:
    """Keep the columns in ``keep`` and those of a name range."""
    span = column_range(df, first, last)
    return df.select(*[c for c in keep or [] if c not in span], *span)


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*column_range(df, first, last))


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "inner", match_missing: bool = False
) -> DataFrame:
    """Join on every column name both sides have.

    ``match_missing`` lets a missing key match a missing key.
    """
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared column to join on")
    if not match_missing:
        return left.join(right, shared, how)
    marked = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(marked[f"__r_{c}"]) for c in shared])
    return left.join(marked, same, how).drop(*[f"__r_{c}" for c in shared])


def append_rows(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rows of both tables, the columns ordered as in the first."""
    return top.unionByName(bottom.select(*top.columns))
