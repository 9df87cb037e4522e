"""Addresses of dispatch records, look-up of coordinates and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.constants import FALLBACK_LONGITUDES
from firstdue.functions.labels import not_fallback_point
from firstdue.functions.nulls import paste
from firstdue.functions.text import expand_state, in_town, street, strip_lead
from firstdue.operators.indicators import count_by
from firstdue.operators.joins import lookup_join


def normalize_address(
    df: DataFrame,
    number: str = "st_num",
    name1: str = "st_name1",
    name2: str = "st_name2",
    variant: str = "v1",
    suffix: str | None = None,
    strip: str = "all",
) -> DataFrame:
    """Add ``address`` and ``full_address``; rows with a blank address are dropped."""
    line = strip_lead(street(F.col(number), F.col(name1), F.col(name2)), " & ", strip)
    full = strip_lead(in_town(F.col("address"), variant, suffix), "NA ", strip)
    return (
        df.withColumn("address", line)
        .filter(F.col("address") != "")
        .withColumn("full_address", strip_lead(full, "0 ", strip))
    )


def geocode(
    records: DataFrame, gazetteer: DataFrame, address: str = "full_address"
) -> DataFrame:
    """Coordinates per record, with the number of records at its address.

    Distinct addresses are looked up once and joined back. Addresses that are
    not found keep missing coordinates.
    """
    found = count_by(records, address).join(gazetteer, address, "left")
    return lookup_join(records, found, address, "inner")


def unmatched_addresses(
    records: DataFrame, gazetteer: DataFrame, address: str = "full_address"
) -> DataFrame:
    """Addresses the gazetteer does not place, with their number of records."""
    placed = gazetteer.filter(F.col("lon").isNotNull()).select(address)
    return count_by(records, address).join(placed, address, "left_anti")


def extend_gazetteer(
    gazetteer: DataFrame,
    answers: DataFrame,
    address: str = "full_address",
    fallback_longitudes: Sequence[float] = FALLBACK_LONGITUDES,
) -> DataFrame:
    """Append newly placed addresses (``lon``, ``lat``) and drop fall-back points."""
    text = expand_state(address)
    added = answers.select(
        text.alias("location"),
        F.lit(None).cast("long").alias("n_incidents"),
        "lon",
        "lat",
        text.alias(address),
    )
    columns = ["location", "n_incidents", "lon", "lat", address]
    both = gazetteer.select(*columns).unionByName(added)
    return both.filter(not_fallback_point(F.col("lon"), fallback_longitudes))


def repeated_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """How many addresses fell on the same point."""
    return (
        df.groupBy(lon, lat)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("point", paste(lon, lat))
    )
