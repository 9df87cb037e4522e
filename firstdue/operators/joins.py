"""Joins of many rows to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to a ``table`` that was grouped by ``key``.

    A grouped table is already partitioned by its key, so Spark would join it
    without a shuffle of its own, and then adaptive execution cannot split a key
    that many rows share. The key's hash as a second join key asks for a fresh
    shuffle of both sides: a hot key is split over tasks, and a table that turns
    out small is broadcast instead.
    """
    mark = "__key_hash"
    hashed = F.xxhash64(key)
    left, right = rows.withColumn(mark, hashed), table.withColumn(mark, hashed)
    return left.join(right, [key, mark], how).drop(mark)
