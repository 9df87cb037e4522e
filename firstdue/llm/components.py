"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.llm.store import stored
from firstdue.operators.joins import lookup_join


def _least_neighbour(directed: DataFrame) -> DataFrame:
    """Every directed link (u, v) with ``m``, the least of u and all its neighbours."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return lookup_join(directed, least, "u", "inner")


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns a and b, both long).

    ``root`` is the least node that can be reached. Each round hangs every larger neighbour
    of a node on the node's least neighbour (large star), then every node's smaller
    neighbours too (small star); the rounds end when the links no longer change, after about
    the logarithm of the longest chain. Links are written after every round, so lineage stays
    short; only a row count and a checksum come to the driver. A node with very many
    neighbours is a hot join key, which adaptive execution splits. Loops and repeated links
    are harmless; no links give no rows.
    """
    now = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = stored(now.distinct(), "links")
    before, state = None, _state(now)
    while state != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        small = _least_neighbour(down)
        moved = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = small.select("u", F.col("m").alias("v"))
        now = stored(moved.union(hung).distinct(), "links")
        before, state = state, _state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
