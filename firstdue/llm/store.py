"""Tables written on the way, in the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from firstdue.session import work_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return a scan of what was written.

    What comes before is then computed once, and a lost executor costs a read of a
    file instead of a new computation. The folder lies under ``spark.checkpoint.dir``.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
