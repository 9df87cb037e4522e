"""First arrivals and the fact table with one row per unit response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from firstdue.functions.text import trim_ws
from firstdue.operators.joins import lookup_join


def first_arrivals(
    arrivals: DataFrame,
    incident: str = "incident_id",
    unit: str = "unit",
    minutes: str = "resp_time",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per incident: the unit that arrived first, and its minutes.

    Missing minutes come last; ties are settled by unit and ``tie_break``. Spark
    keeps one row per incident and task before it shuffles (WindowGroupLimit),
    so an incident with very many rows reaches no single task.
    """
    order = [F.col(c).asc_nulls_last() for c in (minutes, unit, *tie_break)]
    first = F.row_number().over(Window.partitionBy(incident).orderBy(*order))
    return (
        arrivals.withColumn("__rank", first)
        .filter(F.col("__rank") == 1)
        .select(incident, F.col(unit).alias("first_unit"), F.col(minutes).alias("first_resp"))
    )


def drop_blank_incidents(rows: DataFrame, incident: str = "incident_id") -> DataFrame:
    """Rows whose incident has a number: neither missing nor blank."""
    return rows.filter(trim_ws(F.col(incident).cast("string")) != "")


def with_first_arrival(
    activity: DataFrame,
    first: DataFrame,
    incident: str = "incident_id",
    unit: str = "unit",
    locations: DataFrame | None = None,
) -> DataFrame:
    """Left join the first arrival and flag the responses of that unit.

    ``locations`` with the same key come along in the same join, so that the
    many activity rows are shuffled once. The flag compares incident and unit without surrounding
    blanks, the join takes the incident as it is. Only text can carry blanks: there the first
    arrivals are gathered by trimmed incident (a handful per number: as many as it has
    spellings), one look-up brings them all, and each row picks its own.
    """
    known = first if locations is None else first.join(locations, incident, "full")
    trimmed_unit = trim_ws(F.col(unit).cast("string"))
    if not isinstance(activity.schema[incident].dataType, StringType):
        joined = lookup_join(activity, known, incident)
        same = trimmed_unit == trim_ws(F.col("first_unit").cast("string"))
        return joined.withColumn("is_first", F.when(same, 1).otherwise(0))
    values = [c for c in known.columns if c != incident]
    spelt = known.groupBy(trim_ws(F.col(incident)).alias("__plain")).agg(
        F.collect_list(F.struct(F.col(incident).alias("__key"), *values)).alias("__known")
    )
    joined = lookup_join(
        activity.withColumn("__plain", trim_ws(F.col(incident))), spelt, "__plain"
    )
    own = F.get(F.filter("__known", lambda k: k["__key"] == F.col(incident)), F.lit(0))
    hit = F.exists("__known", lambda k: trim_ws(k["first_unit"]) == trimmed_unit)
    return joined.withColumn("__own", own).select(
        *activity.columns, *[F.col(f"__own.{c}").alias(c) for c in values],
        F.when(hit, 1).otherwise(0).alias("is_first"),
    )


def build_responses(
    activity: DataFrame,
    arrivals: DataFrame,
    locations: DataFrame,
    location_key: str = "incident_id",
    incident: str = "incident_id",
    unit: str = "unit",
    minutes: str = "resp_time",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The fact table: every unit response with first arrival and coordinates.

    No join carries a broadcast hint: Spark broadcasts a side whose measured size
    is below its threshold and otherwise splits hot keys of the shuffled join.
    """
    first = first_arrivals(arrivals, incident, unit, minutes, tie_break)
    if location_key == incident:
        return with_first_arrival(activity, first, incident, unit, locations)
    return with_first_arrival(activity, first, incident, unit).join(
        locations, location_key, "left"
    )
