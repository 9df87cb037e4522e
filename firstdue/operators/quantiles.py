"""Exact quantiles per group, also where one group holds most of the rows.

``percentile`` keeps every distinct value of a group in one task and fails on a group of
billions of rows. Here a quantile is found by laying the values out in buckets, for every size
of input:

1. rows are counted per (group, value), with map-side combine, so a value that very many rows
   share is one row from here on;
2. the counted values are laid out by (group, bucket of values). A bucket lies in one task, the buckets
   of a large group in many; what is needed of a bucket is added up where it lies;
3. one row per bucket goes to its group, where a running sum tells which bucket holds a wanted rank;
4. these buckets are read back, where they lie, in order of their values.

Steps 3 and 4 move bucket totals and wanted ranks, not rows. Nothing is sampled, and no task holds a
group. A bucket is a ``2**-10`` part of an octave and is streamed in order; values that differ by far less
than their size share few of them, so take off what they have in common first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 2**10
LOWEST_EXPONENT = -1074  # of a double
HIGHEST_EXPONENT = 1024  # taken by infinity alone
#: The bucket of missing values, below all others.
MISSING = -(2**62)

#: What ``extra`` can ask for: totals of a group, from its buckets.
EXTRAS = {
    "rows": lambda: F.sum("__rows"),
    "missing": lambda: F.sum(F.col("__rows") - F.col("__c")),
    "min": lambda: F.min("__min"),
    "max": lambda: F.max("__max"),
    "sum": lambda: F.sum("__sum"),
    "squares": lambda: F.sum("__squares"),
}
#: What ``extra`` may name, with the totals it is worked out from.
KINDS = {
    **{kind: (kind,) for kind in ("rows", "missing", "min", "max")},
    "mean": ("sum",),
    "variance": ("sum", "squares"),
}


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    extra: Mapping[str, str] | None = None,
    na: str = "skip",
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated (type 7) quantiles of ``value`` per ``keys``.

    ``quantiles`` names the output columns; ``extra`` names further ones, each "rows",
    "missing", "min", "max", "mean" or "variance" (divisor n - 1; it loses digits where values differ by
    far less than their size) of the same group. NaN counts as missing. With ``weight`` a row
    stands for that many equal rows, one at least. A missing key is a group of its own.
    """
    if na not in ("skip", "propagate"):
        raise ValueError(f"unknown policy {na!r}")
    return _found(df, list(keys), value, dict(quantiles), dict(extra or {}), na, weight)


def _bucket(x: Column) -> Column:
    """Bucket number that never falls as ``x`` grows; missing values have one of their own."""
    size = F.abs(x)
    exponent = F.least(F.floor(F.log2(size)), F.lit(HIGHEST_EXPONENT))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * PER_OCTAVE)
    step = F.least(F.greatest(step, F.lit(0)), F.lit(PER_OCTAVE - 1))
    number = (exponent - LOWEST_EXPONENT) * PER_OCTAVE + step + 1
    return (
        F.when(x == 0, F.lit(0).cast("long"))
        .when(x > 0, number.cast("long"))
        .when(x < 0, -number.cast("long"))
        .otherwise(F.lit(MISSING))
    )


def _found(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    extra: dict[str, str],
    na: str,
    weight: str | None,
) -> DataFrame:
    x = F.col(value).cast("double")
    # The keys as one value that is never missing, so that it partitions and joins as it is.
    group = F.struct(*(keys or [F.lit(0).alias("all")])).alias("__g")
    rows = df.select(
        group,
        F.when(~F.isnan(x), x).alias("__x"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w"),
    )
    counted = rows.groupBy("__g", "__x").agg(F.sum("__w").alias("__c"))
    laid = counted.withColumn("__b", _bucket(F.col("__x"))).repartition("__g", "__b")

    parts = {part for kind in extra.values() for part in KINDS[kind]} | {"missing"}
    totals = [f"__t_{kind}" for kind in sorted(parts)]
    known = F.col("__x").isNotNull()
    buckets = laid.groupBy("__g", "__b").agg(
        F.sum(F.when(known, F.col("__c")).otherwise(0)).alias("__c"),
        F.sum("__c").alias("__rows"),
        F.min("__x").alias("__min"),
        F.max("__x").alias("__max"),
        F.sum(F.col("__x") * F.col("__c")).alias("__sum"),
        F.sum(F.col("__x") * F.col("__x") * F.col("__c")).alias("__squares"),
    )
    in_order = Window.partitionBy("__g").orderBy("__b")
    # Ordered as well, so that one sort serves both.
    in_group = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = buckets.withColumns(
        {
            "__n": F.sum("__c").over(in_group),
            "__before": F.sum("__c").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c"),
            "__next": F.lead("__min").over(in_order),
            **{f"__t_{kind}": EXTRAS[kind]().over(in_group) for kind in sorted(parts)},
        }
    )

    # The bucket that holds a quantile's lower rank. The rank above it may open the next bucket,
    # whose least value is then the one. A group without values asks for its missing ones: it
    # still gives a row.
    n, before, c = F.col("__n"), F.col("__before"), F.col("__c")
    asked = []
    for i, p in enumerate(quantiles.values()):
        position = (n - 1) * F.lit(float(p))
        low = F.floor(position) + 1
        holds = (low > before) & (low <= before + c)
        asked.append(
            F.when(
                holds | (n == 0),
                F.struct(
                    F.lit(i).alias("i"), (low - before).alias("low"),
                    (F.least(low + 1, n) - before).alias("high"), (position - F.floor(position)).alias("share"),
                ),
            )
        )
    wanted = ranked.select(
        "__g", "__b", "__n", "__next", *totals, F.array_compact(F.array(*asked)).alias("__asked")
    ).filter(F.size("__asked") > 0)

    # Values of these buckets in order, with running counts.
    upto = Window.partitionBy("__g", "__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    read = laid.join(wanted, ["__g", "__b"]).withColumn("__upto", F.sum("__c").over(upto))
    met = read.select(
        "__g", "__b", "__n", "__next", *totals, "__x", "__upto", "__c", F.inline("__asked")
    )

    def at(rank: str) -> Column:
        here = (F.col(rank) > F.col("__upto") - F.col("__c")) & (F.col(rank) <= F.col("__upto"))
        return F.max(F.when(here, F.col("__x")))

    ends = met.groupBy("__g", "__b", "i").agg(
        at("low").alias("__lo"), F.coalesce(at("high"), F.max("__next")).alias("__hi"),
        *[F.max(name).alias(name) for name in ["share", "__n", *totals]],
    )
    lo, hi, share = F.col("__lo"), F.col("__hi"), F.col("share")
    between = (1 - share) * lo + share * hi
    result = F.when((share == 0) | (lo == hi), lo).otherwise(between)
    if na == "propagate":
        result = F.when(F.col("__t_missing") == 0, result)
    valued = ends.withColumn("__q", result)
    if len(quantiles) == 1:
        valued = valued.withColumn("__q0", F.col("__q"))
    else:
        valued = valued.groupBy("__g").agg(
            *[F.max(name).alias(name) for name in ["__n", *totals]],
            *[F.max(F.when(F.col("i") == i, F.col("__q"))).alias(f"__q{i}") for i in range(len(quantiles))],
        )
    columns = [F.col(f"__q{i}").alias(name) for i, name in enumerate(quantiles)]
    for name, kind in extra.items():
        if kind == "mean":
            total = F.try_divide(F.col("__t_sum"), n)
        elif kind == "variance":
            apart = F.col("__t_squares") - F.try_divide(F.col("__t_sum") * F.col("__t_sum"), n)
            total = F.try_divide(F.greatest(apart, F.lit(0.0)), n - 1)
        else:
            total = F.col(f"__t_{kind}")
        columns.append(total.alias(name))
    return valued.select(*[F.col("__g")[k].alias(k) for k in keys], *columns)
