"""Reading the received time and deriving the date columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_OFFSET = "-05:00"  # fixed offset, no daylight saving
LAST_SHORT_YEAR = 2068  # a two-digit year above 68 belongs to the last century


def parse_received(c: Column | str, offset: str = LOCAL_OFFSET) -> Column:
    """Month/day/year hour:minute text at a fixed offset; NULL if unreadable."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.concat_ws(" ", F.trim(c), F.lit(offset))
    long_year = F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm XXX"))
    short_year = F.try_to_timestamp(text, F.lit("M/d/yy H:mm XXX"))
    century = F.make_interval(years=F.lit(100))
    short_year = F.when(F.year(short_year) > LAST_SHORT_YEAR, short_year - century).otherwise(
        short_year
    )
    return F.coalesce(long_year, short_year)


def wall_clock(ts: Column, zone: str) -> Column:
    """What a clock in ``zone`` shows, as a timestamp without zone."""
    return F.convert_timezone(None, F.lit(zone), ts)


def with_date_parts(
    df: DataFrame, ts: str, offset: str = LOCAL_OFFSET, day_zone: str = "UTC"
) -> DataFrame:
    """Add ``date_short``, ``year_month``, ``month`` and ``year`` (all but the first text).

    The day is taken in ``day_zone`` and the other parts at ``offset``: with the
    defaults an evening call counts for the next day but its own month and year.
    """
    local = wall_clock(F.col(ts), offset)
    return df.withColumns(
        {
            "date_short": wall_clock(F.col(ts), day_zone).cast("date"),
            "year_month": F.date_format(local, "yyyy-MM"),
            "month": F.date_format(local, "MM"),
            "year": F.date_format(local, "yyyy"),
        }
    )
