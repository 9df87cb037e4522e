"""Flags, bands and censoring used by the reports and map feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from firstdue.constants import AMBIGUOUS_ADDRESSES, BAD_ADDRESSES, MIN_GOOD_LAT
from firstdue.functions.nulls import if_else, is_in


def bad_geocode(
    address: Column,
    lat: Column,
    lon: Column,
    bad_addresses: Sequence[str] = BAD_ADDRESSES,
    min_lat: float = MIN_GOOD_LAT,
) -> Column:
    """1 for a missing, known bad or too southern address, 0 for a good one.

    NULL where a coordinate is missing, so the row passes neither test. No bound
    is set on longitude: the known one excludes nothing in the western hemisphere.
    """
    return (
        F.when(address.isNull() | is_in(address, bad_addresses), 1)
        .when(lat < min_lat, 1)
        .when(lat.isNotNull() & lon.isNotNull(), 0)
    )


def ambiguous_address(
    number: Column, address: Column, bare_streets: Sequence[str] = AMBIGUOUS_ADDRESSES
) -> Column:
    """1 where the street number is 0 or missing although the street needs one."""
    return if_else((number == "0") | address.isin(list(bare_streets)), 1, 0)


def not_fallback_point(c: Column, points: Sequence[float], decimals: int = 7) -> Column:
    """False for coordinates a geocoder returns when it found nothing."""
    return ~F.round(c, decimals).isin([float(p) for p in points])


def under_limit(c: Column, limit: float = 5.0) -> Column:
    return if_else(c > limit, "No", "Yes")


def minutes_band(c: Column) -> Column:
    """Half-open bands; everything outside (0, 5], zero included, is "5 +"."""
    return (
        F.when((c > 0) & (c <= 2), "0-2")
        .when((c > 2) & (c <= 4), "2-4")
        .when((c > 4) & (c <= 5), "4-5")
        .when(c.isNotNull(), "5 +")
    )


def censor(c: Column, low: float, high: float) -> Column:
    """Keep values within the limits of a scale, NULL the others."""
    return F.when(c.between(low, high), c)
