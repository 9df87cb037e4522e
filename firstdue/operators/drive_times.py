"""Station by address drive times: what to ask, answers, matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstdue.constants import STATIONS
from firstdue.functions.nulls import paste
from firstdue.functions.text import compact
from firstdue.operators.joins import lookup_join

# Fields read from the answer of a distance service; values are seconds.
ANSWER_SCHEMA = (
    "struct<rows: array<struct<elements: array<struct<"
    "duration: struct<value: bigint>, duration_in_traffic: struct<value: bigint>>>>>>"
)


def destinations(
    points: DataFrame, address: str = "full_address", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """One "lat, lon" text per distinct address, with its number of rows."""
    return points.groupBy(address).agg(
        F.min(paste(lat, lon, sep=", ")).alias("destination"), F.count(F.lit(1)).alias("n")
    )


def pending_pairs(
    addresses: DataFrame,
    known: DataFrame,
    key: str = "full_address",
    stations: Mapping[str, str] = STATIONS,
) -> DataFrame:
    """(address, station) pairs whose drive time is not stored yet.

    The stations are a short fixed list, so they are exploded per address
    instead of joined.
    """
    origins = F.array(
        *[
            F.struct(F.lit(name).alias("station"), F.lit(at).alias("origin"))
            for name, at in stations.items()
        ]
    )
    pairs = addresses.withColumn("destination", compact("destination")).select(
        "*", F.inline(origins)
    )
    return pairs.join(known.select(key, "station"), [key, "station"], "left_anti")


def parse_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """Minutes from landed service answers; NULL where an answer has none."""
    parsed = F.from_json(body, ANSWER_SCHEMA)
    element = F.get(F.get(parsed["rows"], 0)["elements"], 0)
    return answers.withColumn("__element", element).select(
        *[c for c in answers.columns if c != body],
        (F.col("__element.duration.value") / 60).alias("minutes"),
        (F.col("__element.duration_in_traffic.value") / 60).alias("minutes_in_traffic"),
    )


def answer_faults(answers: DataFrame, body: str = "body") -> DataFrame:
    """Answers that give no drive time, with the ``reason`` and the ``body`` as it came.

    Reasons: "missing" (no text), "json" (not an object in JSON), "rows" (no first row or element),
    "duration" (an element without a duration in traffic-free time). An answer without
    ``duration_in_traffic`` is good. Every other column comes along, such as the file it was read from.
    """
    schema = ANSWER_SCHEMA.removesuffix(">") + ", __raw: string>"
    parsed = F.from_json(body, schema, {"columnNameOfCorruptRecord": "__raw"})
    element = F.get(F.get(F.col("__parsed.rows"), 0)["elements"], 0)
    reason = (
        F.when(F.col(body).isNull() | (F.trim(body) == ""), "missing")
        .when(F.col("__parsed").isNull() | F.col("__parsed.__raw").isNotNull(), "json")
        .when(element.isNull(), "rows")
        .when(element["duration"]["value"].isNull(), "duration")
    )
    marked = answers.withColumn("__parsed", parsed).withColumn("reason", reason)
    return marked.filter(F.col("reason").isNotNull()).select(
        *[c for c in answers.columns if c != body], "reason", body
    )


def drive_time_matrix(
    times: DataFrame,
    key: str = "full_address",
    stations: Sequence[str] = tuple(STATIONS),
    traffic: bool = False,
) -> DataFrame:
    """Long drive times as one row per address, one column per station."""
    values = [F.min("minutes").alias("m")]
    if traffic:
        values.append(F.min("minutes_in_traffic").alias("t"))
    wide = times.groupBy(key).pivot("station", list(stations)).agg(*values)
    # Spark names the pivoted columns after the aggregate only if there are two.
    plain = "{}_m" if traffic else "{}"
    columns = [F.col(plain.format(s)).alias(f"from_{s}") for s in stations]
    if traffic:
        columns += [F.col(f"{s}_t").alias(f"from_{s}_in_traffic") for s in stations]
    return wide.select(key, *columns)


def attach_drive_times(
    rows: DataFrame,
    times: DataFrame,
    key: str = "full_address",
    stations: Sequence[str] = tuple(STATIONS),
    traffic: bool = False,
) -> DataFrame:
    """Rows whose address has drive times, with all stations' minutes."""
    matrix = drive_time_matrix(times, key, stations, traffic)
    return lookup_join(rows, matrix, key, "inner")
