"""Mix sources to target weights along a curriculum that changes over training.

Each source owes the mix a number of words. Its weight schedule over training
time t in [0, 1] is piecewise linear; the integral from 0 to t, divided by the
whole integral, is the share of its words that training has asked for by then. A
copy of a document that lies at a cumulative offset in its source's stream, passes over
the source before it counted, is therefore trained at the time at which that share reaches
the offset: the schedule's integral is inverted in closed form, and copies are range-sorted
by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstdue.llm.store import stored
from firstdue.llm.text import KEY, row_key, split_words
from firstdue.operators.joins import lookup_join

#: Relative weight of a source by its place in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Knots (time, height) of the schedule of each weight's sources: the heaviest fade
#: out, the next stay level, the last grow.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)),
)
#: Documents of one source that are summed in one task.
BUCKET_ROWS = 4_000


def source_targets(
    sizes: DataFrame, share: float = 1.5, repeats: int = 2, weights: Sequence[int] = WEIGHTS
) -> DataFrame:
    """One row per source: rows, ``source_size``, ``place`` and ``target``.

    Targets share ``share`` times all words by weight. A target stops at
    ``repeats`` times its source, and what is over goes to the others by weight until
    none is above: with sources in order of how soon they are full, the full ones
    are a prefix, so running sums find the level at once. The table has one row per
    source, however many documents there are.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))))
    per = per.withColumn("__w", weight.cast("double"))
    full = F.col("source_size") * F.lit(float(repeats))
    order = Window.orderBy(full / F.col("__w"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(share)
        - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    ) / F.sum("__w").over(after)
    fits = F.col("__level") * F.col("__w") <= full
    per = per.withColumn("__level", level)
    per = per.withColumn("__level", F.max(F.when(fits, F.col("__level"))).over(everything))
    target = F.least(full, F.col("__level") * F.col("__w"))
    return per.select("source", "source_size", "n_rows", "place", target.alias("target"))


def _time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise-linear schedule reaches ``share``."""
    pieces = list(zip(knots, knots[1:], strict=False))
    areas = [(t1 - t0) * (y0 + y1) / 2 for (t0, y0), (t1, y1) in pieces]
    wanted, done = share * F.lit(sum(areas)), 0.0
    result = None
    for ((t0, y0), (t1, y1)), area in zip(pieces, areas, strict=True):
        left, slope = wanted - F.lit(done), (y1 - y0) / (t1 - t0)
        # y0 * d + slope * d^2 / 2 = left, in the form that also holds for slope 0.
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(y0 * y0) + 2 * slope * left))
        divisor = F.lit(y0) + root
        inside = F.when(divisor > 0, 2 * left / divisor).otherwise(0.0)
        time = F.least(F.lit(t1), F.lit(t0) + inside)
        done += area
        result = F.when(wanted <= done, time) if result is None else result.when(wanted <= done, time)
    return result.otherwise(F.lit(knots[-1][0]))


def plan_mix(
    documents: DataFrame,
    share: float = 1.5,
    repeats: int = 2,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    whole: bool = False,
) -> DataFrame:
    """What the mix takes of each row of ``documents`` (doc_id, text, source).

    Returns ``doc_id, source, size, source_size, target, taken, copies, positions, position``
    and the row key. A source's documents stand in the order of md5(doc_id), then of the
    text, so reruns agree. The stream of a source is its documents, repeated;
    the mix takes the first ``target`` words of it: ``taken`` words of a document, its
    repeats counted. The last document is cut, so sources meet their targets to
    the word; with ``whole`` a copy is taken entirely when its middle lies within the
    target. ``positions`` has the training time (0 to 1) of each of the ``copies``, null where
    nothing of it is taken: that at which the source's schedule has asked for the words
    before the middle of what is taken. ``position`` is the first of them.

    Missing texts and texts without words have size 0 and are not taken. A missing
    source is a source of its own, sorted last; a missing doc_id sorts as an empty
    one. Repeated rows count and are taken one by one. An empty table gives an
    empty table. Other columns are ignored.

    A source may hold most rows: its order is cut by hash into buckets of about
    ``BUCKET_ROWS`` documents, summed apart, and joined by the running sums of the
    buckets.
    """
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    source = F.col("source").cast("string")
    sizes = stored(
        documents.select(
            *row_key(), "doc_id", source.alias("source"), _source_key(source).alias("__key"),
            F.size(split_words(F.col("text"))).cast("long").alias("size"), name.alias("__name"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, share, repeats, weights).withColumns(
        {"__key": _source_key(F.col("source")),
         "__buckets": F.ceil(F.col("n_rows") / F.lit(BUCKET_ROWS))}
    )
    known = lookup_join(sizes, targets.drop("source"), "__key")
    # The first 13 hex digits as a fraction of their range; order is kept.
    spread = F.conv(F.substring("__name", 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    known = known.withColumn("__bucket", F.floor(spread * F.col("__buckets")))

    sums = known.groupBy("__key", "__bucket").agg(F.sum("size").alias("__sum"))
    so_far = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sums.select(
        "__key", "__bucket", F.coalesce(F.sum("__sum").over(so_far), F.lit(0)).alias("__base")
    )
    within = (
        Window.partitionBy("__key", "__bucket")
        .orderBy("__name", "__hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = known.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, ["__key", "__bucket"])
    offset = F.col("__base") + F.col("__before")
    size, limit = F.col("size"), F.floor(F.col("target"))

    def part(turn: int) -> Column:
        left = limit - offset - F.lit(turn) * F.col("source_size")
        if whole:
            return F.when((size > 0) & (2 * left > size), size).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(size, left))

    copies = [part(turn).cast("long") for turn in range(repeats)]
    taken = sum(copies[1:], copies[0])

    def time_of(turn: int) -> Column:
        words = offset + F.lit(turn) * F.col("source_size") + copies[turn] / 2
        reached = F.try_divide(words, F.col("target"))
        time = F.lit(None).cast("double")
        for place, knots in enumerate(schedules):
            here = F.pmod("place", F.lit(len(schedules))) == place
            time = F.when(here, _time_of(reached, knots)).otherwise(time)
        return F.when(copies[turn] > 0, time)

    times = [time_of(turn) for turn in range(repeats)]
    return placed.select(
        *KEY, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        F.array(*copies).alias("copies"), F.array(*times).alias("positions"),
        times[0].alias("position"),
    )


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def mix_documents(documents: DataFrame, position: str | None = None, **options) -> DataFrame:
    """The mixed corpus: the rows of ``documents`` that the mix takes, in training order.

    Whole copies are taken, a repeated document appears again at a training time of its own, and
    rows are range-sorted by it; columns are those of ``documents``, and ``position``, if given,
    is the name of one with that time. See
    ``plan_mix`` for missing values, ties and repeated rows.
    """
    plan = plan_mix(documents, whole=True, **options).filter("taken > 0")
    # Rows with the same id, text and source share a key: pair them off by rank.
    same = [*KEY, "__source"]
    plan = plan.withColumn("__source", _source_key(F.col("source")))
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("position"))
    wanted = plan.withColumn("__rank", rank).select(
        *same, "__rank", F.filter("positions", lambda p: p.isNotNull()).alias("__times")
    )
    numbered = documents.select(
        *row_key(), _source_key(F.col("source").cast("string")).alias("__source"),
        F.struct(*(c for c in documents.columns if c != position)).alias("__row"),
    )
    order = Window.partitionBy(*same).orderBy(F.lit(0))
    numbered = numbered.withColumn("__rank", F.row_number().over(order))
    chosen = numbered.join(wanted, [*same, "__rank"])
    copies = chosen.withColumn("__time", F.explode("__times"))
    ordered = copies.repartitionByRange("__time", "__id", "__hash").sortWithinPartitions(
        "__time", "__id", "__hash"
    )
    return ordered.select("__row.*", *([F.col("__time").alias(position)] if position else []))
