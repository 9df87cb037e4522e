"""Summaries, histograms and two-sample comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstdue.operators.quantiles import group_quantiles

# Of a class width: what counts as lying on a break, when the breaks are chosen and
# when values are counted.
BREAK_EDGE, COUNT_EDGE = 1e-10, 1e-7
# The same for bins of a given width.
BIN_EDGE = 1e-8


def six_number_summary(
    df: DataFrame, value: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values."""
    names = ["min", "q1", "median", "mean", "q3", "max", "n_missing"]
    out = group_quantiles(
        df,
        list(keys),
        value,
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
        {"min": "min", "mean": "mean", "max": "max", "n_missing": "missing"},
    )
    return out.select(*keys, *names)


def centred_bin(x: Column, width: float = 0.5) -> Column:
    """Number of the right-closed bin whose centre is a multiple of ``width``.

    A value within 1e-8 of a width of an edge lies on it, and so in the bin below: most widths and
    edges, such as 0.1 and 0.35, are not exact in binary.
    """
    return F.ceil(x / width - 0.5 - BIN_EDGE).cast("long")


def histogram(
    df: DataFrame, value: str, facet: str | None = None, width: float = 0.5, closed_lowest: bool = False
) -> DataFrame:
    """Counts per bin of fixed width, optionally per facet.

    ``closed_lowest`` puts values exactly on the lowest edge of all data into the first bin, which is the
    one above: no bin is opened for them alone. The lowest value comes from the counted bins.
    """
    keys = [facet] if facet else []
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, centred_bin(F.col(value), width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("__low"))
    )
    if closed_lowest:
        low = counted.agg(F.min("__low")).scalar()
        first = F.floor(F.col("__low") / width - 0.5 + BIN_EDGE).cast("long") + 1
        moved = counted.withColumn("__low", low).withColumn("bin", F.greatest("bin", first))
        counted = moved.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    return counted.select(*keys, "bin", "n").withColumn("centre", F.col("bin") * F.lit(width))


def pretty_breaks(n: Column, low: Column, high: Column) -> dict[str, Column]:
    """Round class width and first and last break for ``n`` values (Sturges).

    Follows the published rule: about log2(n) + 1 classes, the width 1, 2, 5 or
    10 times a power of ten, a larger multiple taken while it lies closer.
    """
    classes = F.ceil(F.log2(n.cast("double")) + 1)
    cell = (high - low) / classes
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))

    def closer(multiple: float, below: float, bias: float) -> Column:
        """Is ``multiple`` the better width than the next smaller one?"""
        return multiple * base - cell < bias * (cell - below * base)

    multiple = (
        F.when(~closer(2.0, 1.0, 1.5), 1.0)
        .when(~closer(5.0, 2.0, 2.75), 2.0)
        .when(~closer(10.0, 5.0, 1.5), 5.0)
        .otherwise(10.0)
    )
    # All values equal: one class of width 1 around them.
    same = low == high
    unit = F.when(same, 1.0).otherwise(multiple * base)
    return {
        "unit": unit,
        "first": F.when(same, F.ceil(low) - 1).otherwise(F.floor(low / unit + BREAK_EDGE)),
        "last": F.ceil(high / unit - BREAK_EDGE),
    }


def auto_histogram(df: DataFrame, value: str) -> DataFrame:
    """Histogram with automatic breaks, empty classes included.

    Classes are right-closed, the lowest also takes its lower end. The three
    numbers that fix the breaks come from one aggregate as a scalar subquery.
    """
    x = F.col(value)
    limits = df.agg(
        F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")
    )
    rule = pretty_breaks(F.col("n"), F.col("low"), F.col("high"))
    breaks = limits.select(
        F.struct(*[c.alias(name) for name, c in rule.items()]).alias("rule")
    ).filter(F.col("rule.unit").isNotNull())
    rows = df.filter(x.isNotNull()).select(x.alias("x"), breaks.scalar().alias("rule"))
    unit, first = F.col("rule.unit"), F.col("rule.first")
    number = F.greatest(F.ceil(F.col("x") / unit - COUNT_EDGE) - first, F.lit(1)).cast("long")
    counted = rows.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.any_value("rule").alias("rule")
    )
    # About log2(n) classes: as one map, to fill in the empty ones.
    counts = counted.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"),
        F.any_value("rule").alias("rule"),
    )
    classes = counts.select(
        F.explode(F.sequence(F.lit(1).cast("long"), (F.col("rule.last") - first).cast("long")))
        .alias("bin"),
        "counts",
        "rule",
    )
    return classes.select(
        "bin",
        ((first + F.col("bin") - 1) * unit).alias("lower"),
        ((first + F.col("bin")) * unit).alias("upper"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def welch_t_test(
    df: DataFrame, value: str, group: str, first: str, second: str
) -> DataFrame:
    """Two-sample t statistic with unequal variances, in one row."""
    x = F.col(value)

    def of(which: str) -> Column:
        return F.when(F.col(group) == which, x)

    stats = df.filter(F.col(group).isin(first, second)).agg(
        *[
            f(of(g)).alias(f"{name}{i}")
            for i, g in ((1, first), (2, second))
            for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    e1 = F.col("var1") / F.col("n1")
    e2 = F.col("var2") / F.col("n2")
    return stats.select(
        "n1",
        "n2",
        "mean1",
        "mean2",
        F.sqrt(e1 + e2).alias("std_error"),
        F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2)).alias("t"),
        F.try_divide(
            (e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)
        ).alias("df"),
    )
