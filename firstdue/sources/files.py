"""CSV feeds with declared types, their bad rows, and the stored drive-time table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from firstdue.sources.saves import compact, read_latest, save

MISSING = "NA"  # how a missing value is spelled in the files
# Quotes are doubled inside quoted text, blanks around it belong to it.
FORMAT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _typed(cell: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.when(cell.isNull(), "").when(cell != MISSING, cell)
    return F.trim(cell).try_cast(kind)


def _as_text(spark: SparkSession, path: str, schema: StructType, multiline: bool) -> DataFrame:
    """Every cell as text under the header's names, which have to cover ``schema``."""
    raw = spark.read.options(**FORMAT).option("multiLine", multiline).csv(path)
    absent = [f.name for f in schema.fields if f.name not in raw.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}; it has {', '.join(raw.columns)}")
    return raw


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    rename: Mapping[str, str] | None = None,
    multiline: bool = False,
    file: str | None = None,
) -> DataFrame:
    """Read the columns of ``schema`` from a CSV feed, by the names in its header.

    Columns may stand in any order among others, such as row names; a missing one fails.
    The letters NA are missing and a blank text cell is a blank text, which
    Spark's own ``nullValue`` cannot tell apart; a number that does not parse is
    missing; ``read_csv_checked`` tells such rows. ``rename`` maps header names to names without dots. All
    files of a folder have one header. Leave ``multiline`` off where no cell holds a line end: such
    files can be split. ``file`` names a further column with the file of each row.
    """
    # Without a schema Spark takes the header's names, and every cell as text.
    raw = _as_text(spark, path, schema, multiline)
    names = dict(rename or {})
    return raw.select(
        *[
            _typed(raw[f"`{f.name}`"], f.dataType).alias(names.get(f.name, f.name))
            for f in schema.fields
        ],
        *[F.col("_metadata.file_path").alias(name) for name in [file] if name],
    )


RAW, FILE = "__raw", "__file"


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: StructType,
    rename: Mapping[str, str] | None = None,
    multiline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The good rows of a CSV feed, and a table of the bad ones.

    A row is bad if it has more or fewer cells than the header, or a cell of a number column that is neither
    blank nor NA nor a number. Good rows are as ``read_csv`` reads them. The second table has one row per
    fault: ``file``, ``reason`` ("cells" or "type"), ``column`` and ``value`` (null for cells), and ``row``,
    the line as it stands in the file for "cells", else its cells as JSON. Nothing is
    lost between the two: every row of the feed is in one of them. Both tables read the files on their own.
    """
    header = _as_text(spark, path, schema, multiline)
    cells = StructType([*header.schema.fields, StructField(RAW, StringType())])
    # Lines are only compared with the header if they are read whole.
    reader = spark.read.schema(cells).options(**FORMAT).option("multiLine", multiline)
    raw = reader.option("columnNameOfCorruptRecord", RAW).option("columnPruning", "false").csv(path)
    names = dict(rename or {})
    quoted = {f.name: F.col(f"`{f.name}`") for f in schema.fields}
    typed = {f.name: _typed(quoted[f.name], f.dataType) for f in schema.fields}
    wrong = {
        f.name: quoted[f.name].isNotNull() & (F.trim(quoted[f.name]) != "")
        & (F.trim(quoted[f.name]) != MISSING) & typed[f.name].isNull()
        for f in schema.fields
        if not isinstance(f.dataType, StringType)
    }
    fault = "struct<reason: string, column: string, value: string>"
    unparsed = [
        F.when(
            F.col(RAW).isNull() & bad,
            F.struct(F.lit("type").alias("reason"), F.lit(name).alias("column"), quoted[name].alias("value")),
        )
        for name, bad in wrong.items()
    ]
    ragged = F.when(
        F.col(RAW).isNotNull(),
        F.struct(
            F.lit("cells").alias("reason"), F.lit(None).cast("string").alias("column"),
            F.lit(None).cast("string").alias("value"),
        ),
    )
    faults = F.array_compact(F.array(*[f.cast(fault) for f in (ragged, *unparsed)]))
    marked = raw.withColumns({FILE: F.col("_metadata.file_path"), "__faults": faults})
    good = marked.filter(F.size("__faults") == 0).select(
        *[typed[f.name].alias(names.get(f.name, f.name)) for f in schema.fields]
    )
    whole = F.coalesce(RAW, F.to_json(F.struct(*[F.col(f"`{c}`") for c in header.columns])))
    bad = marked.select(F.col(FILE).alias("file"), F.inline("__faults"), whole.alias("row"))
    return good, bad


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write with a header, without row names, one file per task."""
    df.write.mode(mode).options(**FORMAT).option("nullValue", MISSING).csv(path)


def save_responses(df: DataFrame, path: str, partition: str = "year") -> None:
    """Store the fact table by year, so that reports read only their years.

    The rebalance hint evens out the files: a big year is split, small ones are
    not scattered over every task.
    """
    df.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def save_drive_times(times: DataFrame, path: str, number: int | None = None) -> int:
    """Add looked-up drive times to the stored ones, as a save with a number, and return that.

    Saves only add, so an interrupted look-up, or one that knows a part of a station's
    addresses, loses nothing; one that runs again under its number adds nothing.
    """
    return save(times, path, number, "station")


def read_drive_times(spark: SparkSession, path: str, key: str = "full_address") -> DataFrame:
    """The stored drive times, one row per ``key`` and station: those of the latest save.

    Rows of one save that repeat a pair are settled by their values, the largest first.
    """
    return read_latest(spark, path, [key, "station"])


def compact_drive_times(spark: SparkSession, path: str, key: str = "full_address") -> int:
    """Put all saves into one table, which later reads take as it is."""
    return compact(spark, path, [key, "station"], "station")
