"""Exact duplicates, with frequent texts settled before anything is shuffled by text.

Texts are equal when their SHA-256 is. A table of (id, digest, row number) is written once;
everything else reads that narrow table:

1. a Misra-Gries summary of the digests (``TRACKED`` counters per task, merged in two levels)
   names every digest that more than ``7 / TRACKED`` of all rows share. It may name others too;
2. the named digests are verified: one exact count and the winning row of each, combined map-side.
   At most ``TRACKED / 3.5`` digests are named, so the table of winners is small at any size of
   input and is broadcast: rows of these digests are settled where they are read;
3. all other digests are shuffled as usual. None of them has more than ``7 / TRACKED`` of the rows,
   so none outgrows an ordinary partition.

The summary decides only which way a row takes; both ways give the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstdue.llm.store import stored
from firstdue.llm.text import blank_if_null

TRACKED = 10_000  # counters of a summary
LANES = 64  # summaries that tasks are merged to before the last merge
#: A summary's counts are off by at most 3.5 / TRACKED of the rows, and it names what is
#: surely above that; so many digests at most can be.
ERROR = 3.5


def _digests(documents: DataFrame, doc_id: str, text: str, *carried: Column) -> DataFrame:
    sha = F.sha2(blank_if_null(F.col(text)).cast("binary"), 256)
    return stored(
        documents.select(
            F.col(doc_id).alias("id"), F.unhex(sha).alias("sha"),
            # Written once, so a row keeps its number whatever is computed again later.
            F.monotonically_increasing_id().alias("row"), *carried,
        ),
        "digests",
    )


def frequent_digests(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``short``: 64-bit hashes of digests, all those of more than 7 / tracked of ``rows`` among them.

    Digests seen once are left out: nothing is gained by them.
    """
    short = rows.select(F.xxhash64("sha").alias("short"), (F.spark_partition_id() % LANES).alias("lane"))
    lanes = short.groupBy("lane").agg(F.expr(f"approx_top_k_accumulate(short, {tracked})").alias("s"))
    # Grouped by a constant, so that a table without rows has no summary.
    whole = lanes.groupBy(F.lit("all").alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    most = math.ceil(tracked / ERROR)
    named = whole.select(F.inline(F.expr(f"approx_top_k_estimate(s, {most})")))
    return named.filter("count > 1").select(F.col("item").alias("short"))


def _winners(rows: DataFrame, tracked: int) -> DataFrame:
    """``sha, n, keep``: exact size and winning row of each frequent digest."""
    named = F.broadcast(frequent_digests(rows, tracked))
    known = rows.withColumn("short", F.xxhash64("sha")).join(named, "short", "left_semi")
    grouped = known.groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("keep")
    )
    return stored(grouped, "frequent")


def mark_copies(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tracked: int = TRACKED
) -> DataFrame:
    """``<doc_id>, keep_id, group_size, kept, text_sha256`` of every row of ``documents``.

    Of equal texts the row with the largest id stays; a missing id is smaller than any. Of rows
    that agree in text and id, one stays, which one is not told apart by this table. A missing text is an
    empty text, and empty texts are copies of each other. Ids may have any type with an order.
    Very long texts are hashed whole. Other columns, whatever their names, are ignored, and an
    empty table gives an empty one.
    """
    rows = _digests(documents, doc_id, text)
    winners = F.broadcast(_winners(rows, tracked))
    common = rows.join(winners, "sha").select("id", "sha", "row", "n", "keep")
    group = Window.partitionBy("sha")
    rare = rows.join(winners, "sha", "left_anti").select(
        "id", "sha", "row", F.count(F.lit(1)).over(group).alias("n"),
        F.max(F.struct("id", "row")).over(group).alias("keep"),
    )
    return common.union(rare).select(
        F.col("id").alias(doc_id), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tracked: int = TRACKED
) -> DataFrame:
    """The rows of ``documents`` that ``mark_copies`` keeps, with all their columns.

    Copies of frequent texts go where they are read; only rows of other texts are shuffled.
    """
    rows = _digests(documents, doc_id, text, F.struct(*documents.columns).alias("doc"))
    winners = F.broadcast(_winners(rows.drop("doc"), tracked))
    common = rows.join(winners, "sha").filter("row = keep.row").select("doc")
    rare = rows.join(winners, "sha", "left_anti")
    first = rare.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("keep")).select("keep.row")
    return common.union(rare.join(first, "row", "left_semi").select("doc")).select("doc.*")
