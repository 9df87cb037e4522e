"""Declared columns of the raw feeds, and their names in this library."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from firstdue.constants import STATIONS

TEXT, NUMBER = StringType(), DoubleType()


def table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


# Header names of the raw feeds (further columns may follow).
ARRIVALS = StructType(
    [StructField("Incnum", TEXT), StructField("Unit", TEXT), StructField("Resp.Time", NUMBER)]
)
ARRIVALS_NAMES = {"Incnum": "incident_id", "Unit": "unit", "Resp.Time": "resp_time"}

ACTIVITY = StructType(
    [
        StructField("CAD.inc.Number", TEXT),
        StructField("Unit", TEXT),
        StructField("Nature.of.Call", TEXT),
        StructField("Date.Time.Received", TEXT),
    ]
)
ACTIVITY_NAMES = {
    "CAD.inc.Number": "incident_id",
    "Unit": "unit",
    "Nature.of.Call": "nature",
    "Date.Time.Received": "received_text",
}

LOCATIONS = StructType(
    [
        StructField("IncNum", TEXT),
        StructField("Full.Address", TEXT),
        StructField("lon", NUMBER),
        StructField("lat", NUMBER),
    ]
)
LOCATIONS_NAMES = {"IncNum": "incident_id", "Full.Address": "full_address"}

GAZETTEER = StructType(
    [
        StructField("Location", TEXT),
        StructField("CountOfincnum", NUMBER),
        StructField("X", NUMBER),
        StructField("Y", NUMBER),
        StructField("Full.Address", TEXT),
    ]
)
GAZETTEER_NAMES = {
    "Location": "location",
    "CountOfincnum": "n_incidents",
    "X": "lon",
    "Y": "lat",
    "Full.Address": "full_address",
}

DISPATCH = StructType(
    [StructField(c, TEXT) for c in ("IncNum", "IncType", "StNum", "StName1", "StName2")]
)
DISPATCH_NAMES = {
    "IncNum": "incident_id",
    "IncType": "incident_type",
    "StNum": "st_num",
    "StName1": "st_name1",
    "StName2": "st_name2",
}

# The stored fact table, as CSV.
MASTER = StructType(
    [
        *ACTIVITY.fields,
        StructField("first.responder", TEXT),
        StructField("first.responder.response.time", NUMBER),
        StructField("Full.Address", TEXT),
        StructField("lon", NUMBER),
        StructField("lat", NUMBER),
        StructField("is.first.responder", IntegerType()),
    ]
)
MASTER_NAMES = {
    **ACTIVITY_NAMES,
    "first.responder": "first_unit",
    "first.responder.response.time": "first_resp",
    "Full.Address": "full_address",
    "is.first.responder": "is_first",
}

# Wide drive times: the fact table with one column per station.
STATION_COLUMNS = [f"from.{s}" for s in STATIONS]
DRIVE_TIMES = StructType([*MASTER.fields, *[StructField(c, NUMBER) for c in STATION_COLUMNS]])
DRIVE_TIMES_TRAFFIC = StructType(
    [*DRIVE_TIMES.fields, *[StructField(f"{c}_in_traffic", NUMBER) for c in STATION_COLUMNS]]
)
DRIVE_TIMES_NAMES = {
    **MASTER_NAMES,
    **{f"{c}{tail}": f"{c}{tail}".replace(".", "_") for c in STATION_COLUMNS for tail in ("", "_in_traffic")},
}

# Attributes of an external geocoder's result.
GEOCODED = StructType(
    [
        StructField("Score", NUMBER),
        StructField("Match_addr", TEXT),
        StructField("Addr_type", TEXT),
        StructField("Full.Address", TEXT),
        StructField("X", NUMBER),
        StructField("Y", NUMBER),
        StructField("n", NUMBER),
        StructField("STATION", TEXT),
    ]
)
GEOCODED_NAMES = {
    "Score": "score",
    "Match_addr": "matched_address",
    "Addr_type": "address_type",
    "Full.Address": "full_address",
    "X": "lon",
    "Y": "lat",
    "n": "n_incidents",
    "STATION": "station",
}
