"""Repeatable sample, distributed row numbers and numbers that stay."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firstdue.functions.nulls import paste
from firstdue.sources.saves import read_latest, save, saved_numbers


def seeded_sample(
    df: DataFrame, n: int, keys: Sequence[str], seed: int, on_short: str = "error"
) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones on every run.

    Rows are drawn in the order of a hash of seed and key, so the draw depends
    neither on partitioning nor on a retry. Each task keeps its ``n`` best rows.
    With fewer than ``n`` rows it fails, or keeps all with ``on_short="keep"``.
    """
    drawn = F.md5(paste(F.lit(seed), *keys, sep="|"))
    order = [drawn, *[F.col(k).asc_nulls_last() for k in keys]]
    sample = df.orderBy(*order).limit(n)
    if on_short == "keep":
        return sample
    if on_short != "error":
        raise ValueError(f"unknown policy {on_short!r}")
    # One number, read as a scalar subquery; a sample without rows has to fail too, so the
    # check stands on a row of its own that is then left out.
    size = sample.agg(F.count(F.lit(1)).alias("__n"))
    message = F.concat(F.lit(f"sample of {n} rows asked from "), F.col("__n").cast("string"))
    checked = size.select(
        F.when(F.col("__n") < n, F.raise_error(message).cast("boolean")).otherwise(True).alias("__ok")
    )
    return sample.filter(checked.scalar()) if n else sample


def with_row_number(df: DataFrame, key: str, name: str, pieces: int | None = None) -> DataFrame:
    """Number the rows 1, 2, … in order of a distinct ``key``.

    One window over everything would sort the table in one task. Instead
    ``pieces`` key values (by default as many as there are shuffle partitions), picked by hash,
    cut the key range; rows are numbered within their piece and shifted by the size of the pieces
    before it. The cut values follow from the data, so a lost task recomputes the same numbers.
    A row finds its piece in two steps, among every ``step``-th cut and then among ``step`` cuts.
    """
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, math.isqrt(pieces))
    cuts = (
        df.select(key)
        .filter(F.col(key).isNotNull())
        .orderBy(F.xxhash64(key), key)
        .limit(pieces)
        .agg(F.array_sort(F.collect_set(key)).alias("cuts"))
    )
    coarse = F.filter("cuts", lambda _, i: i % step == 0)
    both = cuts.select(F.struct("cuts", coarse.alias("coarse")).alias("both"))
    placed = df.withColumn("__cuts", both.scalar())
    block = F.size(F.filter("__cuts.coarse", lambda c: c <= F.col(key)))
    placed = placed.withColumn("__block", block)
    near = F.slice("__cuts.cuts", (F.greatest(F.col("__block"), F.lit(1)) - 1) * step + 1, step)
    inside = F.size(F.filter(near, lambda c: c <= F.col(key)))
    # Missing keys make the last piece.
    piece = F.when(F.col(key).isNull(), pieces + 1).when(F.col("__block") == 0, 0).otherwise(
        (F.col("__block") - 1) * step + inside
    )
    placed = placed.withColumn("__piece", piece).drop("__cuts", "__block")
    sizes = placed.groupBy("__piece").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    # At most pieces + 2 sizes: they come back as one small map, not by a join.
    starts = sizes.select(
        F.struct("__piece", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
        .alias("__entry")
    ).agg(F.map_from_entries(F.collect_list("__entry")))
    within = F.row_number().over(Window.partitionBy("__piece").orderBy(key))
    return (
        placed.withColumns({"__within": within, "__starts": starts.scalar()})
        .withColumn(name, F.element_at("__starts", F.col("__piece")) + F.col("__within"))
        .drop("__piece", "__within", "__starts")
    )


def extend_numbers(
    df: DataFrame, path: str, key: str, name: str, load: int | None = None
) -> DataFrame:
    """The numbers of all keys seen so far: ``key, name, load``, stored in ``path``.

    Keys of ``df`` that are new get the next numbers, in order of the key; a key keeps the number that it
    got first. The numbers run from 1 without gaps. Each call is a numbered save (``load``, by default the next one): a load
    that is repeated adds nothing. A load that was interrupted left nothing, and may run again. Missing
    keys get no number. Loads come one after the other.
    """
    spark = df.sparkSession
    known = saved_numbers(spark, path)
    load = load or max(known, default=0) + 1
    if load not in known:
        keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
        last = F.lit(0).cast("long")
        if known:
            before = read_latest(spark, path, [key])
            keys = keys.join(before, key, "left_anti")
            last = before.agg(F.coalesce(F.max(name), F.lit(0)).cast("long")).scalar()
        numbered = with_row_number(keys, key, name).withColumn("__last", last)
        save(
            numbered.select(key, (F.col("__last") + F.col(name)).alias(name), F.lit(load).cast("long").alias("load")),
            path, load,
        )
    return read_latest(spark, path, [key])
