"""Keyed tables that grow by numbered saves: repeatable, compactable, safe to interrupt.

A save writes one folder per number, ``save_kind=save/save_number=7``; a compaction one with all that was saved up to a
number, ``save_kind=whole/save_number=7``. A folder counts once Spark has put its ``_SUCCESS`` mark there, so
what an interrupted job leaves behind is never read, and is written over by the next try. Nothing that
counts is ever changed: a save whose number is there already adds nothing, and folders that a
compaction has replaced go only when ``drop_replaced`` is called.

Files are listed and deleted through Spark's own file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAVE, WHOLE = "save", "whole"


def _folder(path: str, kind: str, number: int) -> str:
    return f"{path.rstrip('/')}/save_kind={kind}/save_number={number}"


def _store(spark: SparkSession, path: str):
    """The file system of ``path`` and a function that makes its paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind, rising."""
    store, make = _store(spark, path)
    parent = make(f"{path.rstrip('/')}/save_kind={kind}")
    if not store.exists(parent):
        return []
    names = [f.getPath().getName() for f in store.listStatus(parent)]
    found = [int(n.removeprefix("save_number=")) for n in names if n.startswith("save_number=")]
    return sorted(n for n in found if store.exists(make(f"{_folder(path, kind, n)}/_SUCCESS")))


def saved_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all saves that count, also of those that a compaction has taken in since."""
    whole = _numbers(spark, path, WHOLE)
    return sorted({*_numbers(spark, path, SAVE), *whole})


def save(df: DataFrame, path: str, number: int | None = None, partition: str | None = None) -> int:
    """Write ``df`` as save ``number`` (by default the next one) and return the number.

    Later numbers win over earlier ones. A number that is there already, or that a compaction has taken
    in, adds nothing: a job that runs again after a failure names its number. An interrupted save
    leaves nothing that counts.
    """
    spark = df.sparkSession
    known = saved_numbers(spark, path)
    if number is None:
        number = max(known, default=0) + 1
    if number in known or number <= max(_numbers(spark, path, WHOLE), default=0):
        return number
    _write(df, _folder(path, SAVE, number), partition)
    return number


def _write(df: DataFrame, folder: str, partition: str | None) -> None:
    # What lies there already is the rest of an interrupted job.
    writer = df.hint("rebalance", *([partition] if partition else [])).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*folders).drop("save_kind")


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys``: that of the save with the highest number.

    Rows of one save that repeat a key are settled by their values, the largest first. After a compaction
    only later saves are grouped; the compacted table gives what they do not have. A missing key is a
    key like any other. Columns named ``save_kind`` and ``save_number`` are taken.
    """
    whole, saves = _numbers(spark, path, WHOLE), _numbers(spark, path, SAVE)
    base = max(whole, default=None)
    later = [_folder(path, SAVE, n) for n in saves if base is None or n > base]
    if base is None and not later:
        raise ValueError(f"nothing is saved in {path}")
    tail = _latest(_read(spark, path, later), keys) if later else None
    if base is None:
        return tail
    compacted = _read(spark, path, [_folder(path, WHOLE, base)]).drop("save_number")
    compacted = compacted.select(*keys, *[c for c in compacted.columns if c not in keys])
    if tail is None:
        return compacted
    named = tail.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [compacted[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    return tail.unionByName(compacted.join(named, same, "left_anti"))


def _latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "save_number")]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("save_number", *rest)).alias("__row"))
    return latest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, path: str, keys: Sequence[str], partition: str | None = None) -> int:
    """Put all that is saved so far into one table and return the number up to which it goes.

    Readers go on with what was there until the new table is complete. Where nothing was saved since the
    last compaction, nothing is written.
    """
    saves, whole = _numbers(spark, path, SAVE), _numbers(spark, path, WHOLE)
    number = max([*saves, *whole], default=0)
    if number not in whole:
        _write(read_latest(spark, path, keys), _folder(path, WHOLE, number), partition)
    return number


def drop_replaced(spark: SparkSession, path: str) -> None:
    """Delete saves and compactions that the last complete compaction has replaced.

    For an owner who knows that nobody still reads them. What an interruption leaves is not read any more,
    and goes the next time.
    """
    store, make = _store(spark, path)
    last = max(_numbers(spark, path, WHOLE), default=0)
    for kind in (SAVE, WHOLE):
        for number in _numbers(spark, path, kind):
            if number < last or (kind == SAVE and number == last):
                store.delete(make(_folder(path, kind, number)), True)
