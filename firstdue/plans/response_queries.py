"""Checked queries: integration, cleaning and response-time indicators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from firstdue.functions.dates import parse_received, wall_clock, with_date_parts
from firstdue.functions.labels import ambiguous_address, bad_geocode, not_fallback_point
from firstdue.functions.nulls import is_in, not_in
from firstdue.functions.student import t_p_value
from firstdue.operators import columns, distributions, geocoding, indicators, sampling
from firstdue.operators.indicators import critical_first_responses
from firstdue.operators.quantiles import group_quantiles
from firstdue.operators.responses import (
    build_responses, drop_blank_incidents, first_arrivals, with_first_arrival,
)
from firstdue.operators.significance import with_welch_p_value
from firstdue.plans.checks import r, register, rounded, sql, t_tail_sql
from firstdue.sources import adapters as A
from firstdue.sources import tables
from firstdue.sources.files import read_csv, read_csv_checked, save_responses, write_csv
from firstdue.session import work_dir

KEY = ", ".join(A.RESPONSE_KEY)


def _critical(spark, folder, **options):
    return critical_first_responses(A.responses(spark, folder), A.NATURES, **options)


# Integration ------------------------------------------------------------------


@register(
    "first_responder",
    sql(f"select incident_id, first_unit, {r('first_resp')} as first_resp from first_arrival"),
)
def _(spark, folder):
    first = first_arrivals(A.arrivals(spark, folder), tie_break=A.TIE_BREAK)
    return rounded(first, "first_resp")


@register(
    "first_responder_flag",
    sql("select is_first, count(*) as n from fd group by is_first"),
)
def _(spark, folder):
    # Text keys: the flag then needs the look-up on trimmed keys.
    text = F.col("incident_id").cast("string")
    first = first_arrivals(
        A.arrivals(spark, folder).withColumn("incident_id", text), tie_break=A.TIE_BREAK
    )
    activity = A.activity(spark, folder).withColumn("incident_id", text)
    return indicators.count_by(with_first_arrival(activity, first), "is_first")


@register(
    "master_table",
    sql(
        f"select {KEY}, unit, nature, year, addr_id, full_address, {r('lon')} as lon, "
        f"{r('lat')} as lat, first_unit, {r('first_resp')} as first_resp, is_first from fd"
    ),
)
def _(spark, folder):
    fd = A.responses(spark, folder).select(
        *A.RESPONSE_KEY, "unit", "nature", "year", "addr_id", "full_address", "lon", "lat",
        "first_unit", "first_resp", "is_first",
    )
    return rounded(fd, "lon", "lat", "first_resp")


@register(
    "master_table_text_keys",
    sql("select concat(' ', incident_id, ' ') as incident_id, concat(unit, ' ') as unit, "
        "line, part, supp, cents, "
        f"first_unit, {r('first_resp')} as first_resp, is_first from fd"),
)
def _(spark, folder):
    # Text keys with blanks around them: the join takes them as they are, the flag trims.
    text = F.concat(F.lit(" "), F.col("incident_id").cast("string"), F.lit(" "))
    first = first_arrivals(
        A.arrivals(spark, folder).withColumn("incident_id", text), tie_break=A.TIE_BREAK
    )
    activity = A.activity(spark, folder).withColumns(
        {"incident_id": text, "unit": F.concat("unit", F.lit(" "))}
    )
    fd = with_first_arrival(activity, first).select(
        *A.RESPONSE_KEY, "unit", "first_unit", "first_resp", "is_first"
    )
    return rounded(fd, "first_resp")


@register(
    "named_incidents",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey % 7 <> 0",
)
def _(spark, folder):
    # A seventh of the incidents blank, as in feeds with unnumbered calls.
    lines = A.raw(spark, folder, "lineitem")
    blank = F.when(F.col("l_orderkey") % 7 == 0, " ").otherwise(F.col("l_orderkey").cast("string"))
    named = drop_blank_incidents(lines.withColumn("incident_id", blank))
    return named.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register(
    "feed_tables",
    f"""
select 'arrivals' as feed, cast(l_orderkey as varchar) as key,
  concat('U', cast(l_suppkey % 8 as varchar)) as name, {r('l_extendedprice / 10000')} as x,
  null::double as y from lineitem
union all select 'activity', cast(o_orderkey as varchar), o_orderpriority, null, null from orders
union all select 'locations', cast(vec_id as varchar), concat(cast(vec_id as varchar),
  ' MAIN ST{A.TOWN}'), {r('-71.10 + 0.1 * cast(embedding[1] as double)')},
  {r('42.3875 + 0.1 * cast(embedding[2] as double)')} from embeddings
""",
)
def _(spark, folder):
    # Feeds as their writers leave them: other order, row names, further columns.
    arrivals = A.arrivals(spark, folder).select(
        F.col("line").alias("X"), F.col("resp_time").alias("Resp.Time"),
        F.col("unit").alias("Unit"), F.col("incident_id").alias("Incnum"),
    )
    activity = A.raw(spark, folder, "orders").select(
        F.lit("").alias("Date.Time.Received"), F.col("o_orderpriority").alias("Nature.of.Call"),
        F.lit("U1").alias("Unit"), F.col("o_orderkey").alias("CAD.inc.Number"),
    )
    places = A.locations(spark, folder).select(
        F.lit(1).alias("X"), F.col("lat"), F.col("addr_id").alias("IncNum"),
        F.col("full_address").alias("Full.Address"), F.lit(2).alias("n"), F.col("lon"),
    )

    def back(feed, name, schema, names):
        path = work_dir(spark, name)
        write_csv(feed, path)
        return read_csv(spark, path, schema, names)

    none = F.lit(None).cast("double")
    read = back(arrivals, "arrivals", tables.ARRIVALS, tables.ARRIVALS_NAMES)
    out = read.select(
        F.lit("arrivals").alias("feed"), F.col("incident_id").alias("key"),
        F.col("unit").alias("name"), F.col("resp_time").alias("x"), none.alias("y"),
    )
    read = back(activity, "activity", tables.ACTIVITY, tables.ACTIVITY_NAMES)
    out = out.union(read.select(F.lit("activity"), "incident_id", "nature", none, none))
    read = back(places, "locations", tables.LOCATIONS, tables.LOCATIONS_NAMES)
    out = out.union(read.select(F.lit("locations"), "incident_id", "full_address", "lon", "lat"))
    return rounded(out, "x", "y")


@register(
    "stored_report",
    sql(
        f"select unit, {r('quantile_cont(resp_time, 0.5)')} as median, count(*) as n from ust "
        "where year = '1997' group by unit"
    ),
)
def _(spark, folder):
    # Feeds, clean, fact, dates, store; the report reads its year's folder alone.
    received = A.received(spark, folder)
    activity = drop_blank_incidents(A.activity(spark, folder).drop("year", "date_short"))
    fact = build_responses(
        activity.join(received, "incident_id"), A.arrivals(spark, folder),
        A.locations(spark, folder), location_key="addr_id", tie_break=A.TIE_BREAK,
    )
    dated = with_date_parts(fact.withColumn("ts", parse_received("received_text")), "ts")
    path = work_dir(spark, "responses")
    save_responses(dated, path)
    rows = spark.read.parquet(path).filter(F.col("year") == "1997")
    report = group_quantiles(rows, ["unit"], "resp_time", {"median": 0.5}, {"n": "rows"})
    return rounded(report, "median")


@register(
    "csv_roundtrip",
    "select l_orderkey as incident_id, concat('U', cast(l_suppkey % 8 as varchar)) as unit, "
    f"{r('l_extendedprice / 10000')} as resp_time from lineitem",
)
def _(spark, folder):
    path = work_dir(spark, "csv_roundtrip")
    write_csv(A.arrivals(spark, folder).select("incident_id", "unit", "resp_time"), path)
    schema = StructType(
        [
            StructField("incident_id", LongType()),
            StructField("unit", StringType()),
            StructField("resp_time", DoubleType()),
        ]
    )
    return rounded(read_csv(spark, path, schema), "resp_time")


SPOILT = (
    "select l_orderkey as id, concat('U', cast(l_suppkey % 8 as varchar)) as unit, "
    "l_orderkey % 11 = 0 as wordy, l_orderkey % 13 = 0 as longer, l_extendedprice / 10000 as x from lineitem"
)


@register(
    "csv_good_rows",
    f"select cast(id as varchar) as incident_id, unit, {r('x')} as resp_time from ({SPOILT}) "
    "where not wordy and not longer",
)
def _(spark, folder):
    good, _ = read_csv_checked(spark, _spoilt_feed(spark, folder), tables.ARRIVALS, tables.ARRIVALS_NAMES)
    return rounded(good, "resp_time")


@register(
    "csv_rejects",
    "select case when longer then 'cells' else 'type' end as reason, "
    "case when not longer then 'Resp.Time' end as column_name, case when not longer then 'n/a' end as value, "
    "case when longer then concat_ws(',', id, unit, case when wordy then 'n/a' else '1.5' end, 'more') "
    "else concat('{\"Incnum\":\"', id, '\",\"Unit\":\"', unit, '\",\"Resp.Time\":\"n/a\"}') end as \"row\", "
    f"true as has_file from ({SPOILT}) where wordy or longer",
)
def _(spark, folder):
    _, bad = read_csv_checked(spark, _spoilt_feed(spark, folder), tables.ARRIVALS, tables.ARRIVALS_NAMES)
    return bad.select(
        "reason", F.col("column").alias("column_name"), "value", "row",
        F.col("file").endswith(".csv").alias("has_file"),
    )


def _spoilt_feed(spark, folder) -> str:
    """A feed as text: some times are words, some lines have a cell too many."""
    x = F.col("resp_time").cast("string")
    wordy, longer = F.col("incident_id") % 11 == 0, F.col("incident_id") % 13 == 0
    cells = F.concat_ws(
        ",", F.col("incident_id").cast("string"), "unit",
        F.when(wordy, "n/a").when(longer, "1.5").otherwise(x), F.when(longer, "more"),
    )
    # The whole line is one cell, written as it is.
    line = A.arrivals(spark, folder).select(cells.alias("Incnum,Unit,Resp.Time"))
    path = work_dir(spark, "spoilt")
    line.write.options(header="true", quote="\u0000", sep="\u0001").csv(path)
    return path


@register(
    "parse_received",
    "select o_orderkey as incident_id, strftime(o_orderdate, '%Y-%m-%d %H:%M') as local_time, "
    "cast(epoch(o_orderdate) as bigint) + 18000 as unix_time from orders",
)
def _(spark, folder):
    ts = parse_received("received_text")
    return A.received(spark, folder).select(
        "incident_id",
        F.date_format(wall_clock(ts, "-05:00"), "yyyy-MM-dd HH:mm").alias("local_time"),
        F.unix_timestamp(ts).alias("unix_time"),
    )


@register(
    "date_parts",
    "select event_id, cast(ts as date) as date_short, "
    "strftime(ts - interval 5 hour, '%Y-%m') as year_month, "
    "strftime(ts - interval 5 hour, '%m') as month, "
    "strftime(ts - interval 5 hour, '%Y') as year from events",
)
def _(spark, folder):
    events = with_date_parts(A.raw(spark, folder, "events"), "ts")
    return events.select("event_id", "date_short", "year_month", "month", "year")


# Columns and filters ----------------------------------------------------------


@register(
    "select_range",
    "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
)
def _(spark, folder):
    orders = A.raw(spark, folder, "orders")
    kept = columns.select_range(orders, "o_orderstatus", "o_orderpriority", ["o_orderkey"])
    return columns.drop_range(kept, "o_orderdate", "o_orderdate")


@register(
    "filter_chain",
    sql(
        f"select {KEY}, unit, year from ust where nature <> '{A.TRAINING}' and unit <> '' "
        "and resp_time < 10 and resp_time > 0.5"
    ),
)
def _(spark, folder):
    rows = A.activity(spark, folder).filter(F.col("nature") != A.TRAINING)
    rows = rows.filter((F.col("unit") != "") & (F.col("resp_time") < 10))
    return rows.filter(F.col("resp_time") > 0.5).select(*A.RESPONSE_KEY, "unit", "year")


@register(
    "critical_filter",
    sql(
        f"select {KEY}, unit, nature from critical where unit in ('U1','U2','U3','U6','U7') "
        "and lon is not null"
    ),
)
def _(spark, folder):
    rows = _critical(spark, folder, units=A.ENGINES).filter(F.col("lon").isNotNull())
    return rows.select(*A.RESPONSE_KEY, "unit", "nature")


@register(
    "not_in_filter",
    sql(
        f"select {KEY}, unit from ust where coalesce(nature not in ('1-URGENT','2-HIGH',"
        "'3-MEDIUM'), true) and coalesce(unit not in ('U1','U2','U3','U6','U7'), true)"
    ),
)
def _(spark, folder):
    rows = A.activity(spark, folder)
    kept = rows.filter(not_in("nature", A.NATURES) & not_in("unit", A.ENGINES))
    return kept.select(*A.RESPONSE_KEY, "unit")


BAD_STAND_INS = [f"{i} MAIN ST{A.TOWN}" for i in (7, 11, 13)]


@register(
    "bad_geocode_flag",
    sql(
        f"select {KEY}, case when full_address is null then 1 when full_address in "
        f"('7 MAIN ST{A.TOWN}', '11 MAIN ST{A.TOWN}', '13 MAIN ST{A.TOWN}') then 1 "
        "when lat < 42.37 then 1 when lat is not null and lon is not null then 0 end "
        "as bad_geocode from fd"
    ),
)
def _(spark, folder):
    flag = bad_geocode(F.col("full_address"), F.col("lat"), F.col("lon"), BAD_STAND_INS)
    return A.responses(spark, folder).select(*A.RESPONSE_KEY, flag.alias("bad_geocode"))


# Addresses --------------------------------------------------------------------

DISPATCH = """
cad as (
  select o_orderkey as incident_id,
    case when o_orderkey % 10 = 0 then '' when o_orderkey % 10 = 1 then '0'
      else cast(o_custkey % 300 as varchar) end as st_num,
    case when o_orderkey % 50 = 0 or o_orderkey % 100 = 20 then ''
      when c_custkey % 2 = 0 then concat(n_name, ' AV') else concat(n_name, ' A ST') end
      as st_name1,
    case when o_orderkey % 100 = 0 or o_orderkey % 20 = 10 then ''
      else concat(c_mktsegment, ' AV') end as st_name2
  from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey)
"""
MAIN_STREET = """
cad as (
  select o_orderkey as incident_id, cast(o_custkey as varchar) as st_num,
    'MAIN ST' as st_name1, '' as st_name2 from orders)
"""


def _normal(suffix: str, rules: list[tuple[str, str]]) -> str:
    text = f"trim(concat(address, '{suffix}'))"
    for old, new in rules:
        text = f"replace({text}, '{old}', '{new}')"
    return f"""
joined as (
  select *, case when st_num <> '' then concat(st_num, ' ', st_name1)
    else concat(st_name1, ' & ', st_name2) end as raw_address from cad),
lead as (
  select *, case when starts_with(raw_address, ' & ') then replace(raw_address, ' & ', '')
    else raw_address end as address from joined),
cleaned as (select *, {text} as t from lead where address <> ''),
without_na as (
  select *, case when starts_with(t, 'NA ') then replace(t, 'NA ', '') else t end as u
  from cleaned),
records as (
  select incident_id, st_num, address,
    case when starts_with(u, '0 ') then replace(u, '0 ', '') else u end as full_address
  from without_na)
"""


V1 = [
    ("AV,", "AVE,"), ("AV &", "AVE &"), (" A ", " "), (" B ", " "), (" R ", " "),
    (" & ,", ","), (" OPPOSITE ", " "), (" & ", " and "),
]
V2 = [
    ("AV,", "AVE,"), ("AV &", "AVE &"), (" A ", " "), (" B ", " "), (" & ,", ","),
    (" OPPOSITE ", " "),
]
STATE = A.TOWN + ", Massachusetts"


@register(
    "address_normalize",
    sql("select incident_id, address, full_address from records", DISPATCH, _normal(STATE, V1)),
)
def _(spark, folder):
    records = geocoding.normalize_address(A.dispatch(spark, folder), suffix=STATE)
    return records.select("incident_id", "address", "full_address")


@register(
    "address_normalize_v2",
    sql(
        "select incident_id, address, full_address from records",
        DISPATCH,
        _normal(A.TOWN + ", MA", V2),
    ),
)
def _(spark, folder):
    records = geocoding.normalize_address(
        A.dispatch(spark, folder), variant="v2", suffix=A.TOWN + ", MA"
    )
    return records.select("incident_id", "address", "full_address")


BARE = ["NATION_2 AVE" + A.TOWN, "NATION_3 ST" + A.TOWN]


@register(
    "ambiguous_address",
    sql(
        "select incident_id, full_address, case when st_num = '0' or full_address in "
        f"('{BARE[0]}', '{BARE[1]}') then 1 else 0 end as ambiguous from records",
        DISPATCH,
        _normal(A.TOWN, V2),
    ),
)
def _(spark, folder):
    records = geocoding.normalize_address(A.dispatch(spark, folder), variant="v2", suffix=A.TOWN)
    flag = ambiguous_address(F.col("st_num"), F.col("full_address"), BARE)
    return records.select("incident_id", "full_address", flag.alias("ambiguous"))


@register(
    "address_count",
    sql(
        "select full_address, count(*) as n from records group by full_address",
        DISPATCH,
        _normal(STATE, V1),
    ),
)
def _(spark, folder):
    records = geocoding.normalize_address(A.dispatch(spark, folder), suffix=STATE)
    return indicators.count_by(records, "full_address")


@register(
    "distinct_addresses",
    sql("select distinct full_address from records", DISPATCH, _normal(STATE, V1)),
)
def _(spark, folder):
    records = geocoding.normalize_address(A.dispatch(spark, folder), suffix=STATE)
    return records.select("full_address").distinct()


@register(
    "address_id",
    sql(
        "select full_address, row_number() over (order by full_address) as row_number "
        "from (select distinct full_address from records)",
        DISPATCH,
        _normal(STATE, V1),
    ),
)
def _(spark, folder):
    records = geocoding.normalize_address(A.dispatch(spark, folder), suffix=STATE)
    distinct = records.select("full_address").distinct()
    return sampling.with_row_number(distinct, "full_address", "row_number")


@register(
    "address_dictionary",
    sql(
        "select full_address, row_number() over (order by full_address) as number, 1::bigint as load "
        "from (select distinct full_address from records where incident_id % 2 = 0) "
        "union all select full_address, (select count(distinct full_address) from records "
        "where incident_id % 2 = 0) + row_number() over (order by full_address), 2::bigint from ("
        "select full_address from records group by full_address "
        "having count(*) filter (incident_id % 2 = 0) = 0)",
        DISPATCH,
        _normal(STATE, V1),
    ),
)
def _(spark, folder):
    # Half of the calls, then all of them, and these once more as after a failure.
    records = geocoding.normalize_address(A.dispatch(spark, folder), suffix=STATE)
    path = work_dir(spark, "addresses")
    sampling.extend_numbers(records.filter("incident_id % 2 = 0"), path, "full_address", "number", 1)
    sampling.extend_numbers(records, path, "full_address", "number", 2)
    return sampling.extend_numbers(records, path, "full_address", "number", 2).select(
        "full_address", "number", "load"
    )


@register(
    "top_addresses",
    sql(
        "select full_address, count(*) as n from records group by full_address "
        "order by n desc, full_address limit 80",
        DISPATCH,
        _normal(STATE, V1),
    ),
)
def _(spark, folder):
    records = geocoding.normalize_address(A.dispatch(spark, folder), suffix=STATE)
    return indicators.top_counts(records, "full_address", 80)


def _main_street(spark, folder):
    return geocoding.normalize_address(A.main_street(spark, folder), suffix=A.TOWN)


@register(
    "geocode_lookup",
    sql(
        "select r.incident_id, r.full_address, d.n, "
        f"{r('g.lon')} as lon, {r('g.lat')} as lat from records r "
        "join (select full_address, count(*) as n from records group by full_address) d "
        "on d.full_address = r.full_address left join geo g on g.full_address = r.full_address",
        MAIN_STREET,
        _normal(A.TOWN, V1),
    ),
)
def _(spark, folder):
    gazetteer = A.locations(spark, folder).drop("addr_id")
    found = geocoding.geocode(_main_street(spark, folder), gazetteer)
    return rounded(found.select("incident_id", "full_address", "n", "lon", "lat"), "lon", "lat")


@register(
    "geocode_unmatched",
    sql(
        "select r.full_address, count(*) as n from records r left join geo g "
        "on g.full_address = r.full_address where g.lon is null group by r.full_address",
        MAIN_STREET,
        _normal(A.TOWN, V1),
    ),
)
def _(spark, folder):
    return geocoding.unmatched_addresses(
        _main_street(spark, folder), A.locations(spark, folder)
    )


FALLBACK = [-71.19, -71.188]
STREET_NUMBER = "try_cast(regexp_extract(full_address, '^[0-9]+') as double)"


@register(
    "union_append",
    sql(
        f"""select location, n_incidents, {r('lon')} as lon, {r('lat')} as lat, full_address
from (
  select split_part(full_address, ',', 1) as location, cast(1 as bigint) as n_incidents,
    lon, lat, full_address from geo
  union all
  select replace(full_address, ', MA', ', Massachusetts'), null, lon, lat,
    replace(full_address, ', MA', ', Massachusetts') from answers)
where round(lon, 7) not in (-71.19, -71.188)""",
        MAIN_STREET,
        _normal(A.TOWN, V1),
        f"""
answers as (
  select concat(full_address, ', MA') as full_address,
    -71.2 + {STREET_NUMBER} / 100000 as lon, 42.38 as lat
  from (select distinct r.full_address from records r left join geo g
    on g.full_address = r.full_address where g.lon is null)
  where regexp_matches(full_address, '^[0-9]'))""",
    ),
)
def _(spark, folder):
    places = A.locations(spark, folder)
    gazetteer = places.select(
        F.split_part("full_address", F.lit(","), F.lit(1)).alias("location"),
        F.lit(1).cast("long").alias("n_incidents"), "lon", "lat", "full_address",
    )
    missing = geocoding.unmatched_addresses(_main_street(spark, folder), places)
    number = F.regexp_extract("full_address", "^[0-9]+", 0)
    answers = missing.filter(F.col("full_address").rlike("^[0-9]")).select(
        F.concat("full_address", F.lit(", MA")).alias("full_address"),
        (F.lit(-71.2) + number.cast("double") / 100000).alias("lon"),
        F.lit(42.38).alias("lat"),
    )
    both = geocoding.extend_gazetteer(gazetteer, answers, fallback_longitudes=FALLBACK)
    return rounded(both, "lon", "lat")


@register(
    "repeated_points",
    sql(
        "select round(lon, 2) as lon, round(lat, 2) as lat, count(*) as n from geo "
        "group by round(lon, 2), round(lat, 2)"
    ),
)
def _(spark, folder):
    places = A.locations(spark, folder).withColumns(
        {"lon": F.round("lon", 2), "lat": F.round("lat", 2)}
    )
    return geocoding.repeated_points(places).drop("point")


@register(
    "exclude_fallback_points",
    sql(
        f"select addr_id, {r('lon')} as lon from geo "
        "where round(lon, 2) not in (-71.10, -71.09, -71.12)"
    ),
)
def _(spark, folder):
    places = A.locations(spark, folder).select("addr_id", "lon")
    keep = not_fallback_point(F.col("lon"), [-71.10, -71.09, -71.12], decimals=2)
    return rounded(places.filter(keep), "lon")


@register(
    "natural_join",
    sql(
        "select l.incident_id, l.unit, l.runs, r.last_line from "
        "(select incident_id, unit, count(*) as runs from ust group by incident_id, unit) l "
        "join (select incident_id, unit, max(line) as last_line from onloc "
        "group by incident_id, unit) r on l.incident_id = r.incident_id and l.unit = r.unit"
    ),
)
def _(spark, folder):
    runs = A.activity(spark, folder).groupBy("incident_id", "unit").agg(
        F.count(F.lit(1)).alias("runs")
    )
    last = A.arrivals(spark, folder).groupBy("incident_id", "unit").agg(
        F.max("line").alias("last_line")
    )
    return columns.natural_join(runs, last)


# Indicators -------------------------------------------------------------------


@register("count_by_nature", sql("select nature, count(*) as n from ust group by nature"))
def _(spark, folder):
    return indicators.count_by(A.activity(spark, folder), "nature")


def _spread_sql(source: str, value: str, key: str | None = "unit") -> str:
    years = ", ".join(
        f"max(case when year = '{y}' then {value} end) as y_{y}" for y in A.YEARS
    )
    change = f"(y_{A.AFTER} - y_{A.BEFORE}) / nullif(y_{A.BEFORE}, 0)"
    shown = ", ".join(f"{r(f'y_{y}')} as y_{y}" for y in A.YEARS)
    keys = f"{key}, " if key else ""
    group = f" group by {key}" if key else ""
    return (
        f"select {keys}{shown}, {r(change)} as per_change "
        f"from (select {keys}{years} from ({source}){group})"
    )


def _rounded_years(df):
    return rounded(df, *[f"y_{y}" for y in A.YEARS], "per_change")


CHANGE = (A.YEARS, A.BEFORE, A.AFTER)


@register(
    "avg_runs_per_day",
    sql(
        _spread_sql(
            "select unit, year, avg(n) as m from (select unit, year, date_short, count(*) as n "
            "from (select incident_id, unit, date_short, min(year) as year from ust "
            f"where nature <> '{A.TRAINING}' and unit <> '' group by all) group by all) "
            "group by unit, year",
            "m",
        )
    ),
)
def _(spark, folder):
    return _rounded_years(
        indicators.avg_runs_per_day(A.activity(spark, folder), *CHANGE, training=A.TRAINING)
    )


def _quantile_sql(p: float, where: str = "true", key: str | None = "unit") -> str:
    keys = "unit, year" if key else "year"
    return _spread_sql(
        f"select {keys}, quantile_cont(first_resp, {p}) as m from critical "
        f"where {where} group by {keys}",
        "m",
        key,
    )


@register("median_by_unit_year", sql(_quantile_sql(0.5)))
def _(spark, folder):
    rows = _critical(spark, folder)
    return _rounded_years(indicators.quantile_by_unit_year(rows, 0.5, *CHANGE))


@register("median_no_outliers", sql(_quantile_sql(0.5, "first_resp < 10")))
def _(spark, folder):
    rows = _critical(spark, folder, below_minutes=10)
    return _rounded_years(indicators.quantile_by_unit_year(rows, 0.5, *CHANGE))


@register(
    "median_engines", sql(_quantile_sql(0.5, "unit in ('U1', 'U2', 'U3', 'U6', 'U7')"))
)
def _(spark, folder):
    rows = _critical(spark, folder, units=A.ENGINES)
    return _rounded_years(indicators.quantile_by_unit_year(rows, 0.5, *CHANGE))


@register("p90_by_unit_year", sql(_quantile_sql(0.9)))
def _(spark, folder):
    rows = _critical(spark, folder)
    return _rounded_years(indicators.quantile_by_unit_year(rows, 0.9, *CHANGE))


@register("p90_by_year", sql(_quantile_sql(0.9, key=None)))
def _(spark, folder):
    rows = _critical(spark, folder)
    return _rounded_years(indicators.quantile_by_year(rows, 0.9, *CHANGE))


@register(
    "exceedance_share",
    sql(
        f"select o.year, o.n, a.n_all, {r('o.n / a.n_all')} as share from "
        "(select year, count(*) as n from critical where first_resp > 5 group by year) o "
        "join (select year, count(*) as n_all from critical group by year) a on a.year = o.year"
    ),
)
def _(spark, folder):
    return rounded(indicators.exceedance_share(_critical(spark, folder)), "share")


BIN = "cast(ceil((first_resp - 0.25) / 0.5) as bigint)"


@register(
    "histogram_by_unit",
    sql(
        f"select unit, {BIN} as bin, count(*) as n, {BIN} * 0.5::double as centre from critical "
        "where first_resp < 7.5 and unit in ('U1', 'U2', 'U3', 'U6', 'U7') group by unit, bin"
    ),
)
def _(spark, folder):
    rows = _critical(spark, folder, units=A.ENGINES, below_minutes=7.5)
    return distributions.histogram(rows, "first_resp", "unit")


@register(
    "histogram_by_year",
    sql(
        f"select year, {BIN} as bin, count(*) as n, {BIN} * 0.5::double as centre from critical "
        "where first_resp < 7.5 group by year, bin"
    ),
)
def _(spark, folder):
    rows = _critical(spark, folder, below_minutes=7.5)
    return distributions.histogram(rows, "first_resp", "year")


@register(
    "histogram_tenths",
    sql(
        "select unit, cast(greatest(ceil((k - 1) / 2), floor((low - 1) / 2) + 1) as bigint) as bin, "
        "count(*) as n from (select unit, k, min(k) over () as low from ("
        "select unit, cast(round(first_resp * 20) as bigint) as k from critical)) group by unit, bin"
    ),
)
def _(spark, folder):
    # Minutes in twentieths: every second one lies on an edge, which is not exact in binary.
    rows = _critical(spark, folder).withColumn("x", F.round(F.col("first_resp") * 20) / 20)
    return distributions.histogram(rows, "x", "unit", 0.1, closed_lowest=True).select("unit", "bin", "n")


WELCH = (
    "select n1, n2, mean1, mean2, sqrt(v1/n1 + v2/n2) as std_error, "
    "(mean1 - mean2) / sqrt(v1/n1 + v2/n2) as t, "
    "pow(v1/n1 + v2/n2, 2) / (pow(v1/n1, 2)/(n1 - 1) + pow(v2/n2, 2)/(n2 - 1)) as df from ("
    "select count(*) filter (year = '1997') as n1, count(*) filter (year = '2000') as n2, "
    "avg(first_resp) filter (year = '1997') as mean1, "
    "avg(first_resp) filter (year = '2000') as mean2, "
    "var_samp(first_resp) filter (year = '1997') as v1, "
    "var_samp(first_resp) filter (year = '2000') as v2 from critical)"
)


def _welch(spark, folder):
    return distributions.welch_t_test(
        _critical(spark, folder), "first_resp", "year", "1997", "2000"
    )


@register(
    "welch_t_test",
    sql(
        "select n1, n2, "
        + ", ".join(f"{r(c)} as {c}" for c in ("mean1", "mean2", "std_error", "t", "df"))
        + f" from ({WELCH})"
    ),
)
def _(spark, folder):
    return rounded(_welch(spark, folder), "mean1", "mean2", "std_error", "t", "df")


# The limits are checked by what they mean: the probability beyond half their distance in
# standard errors is 5 %.
WELCH_SHOWN = ("mean1", "mean2", "std_error", "t", "df")


@register(
    "welch_p_value",
    sql(
        "select n1, n2, "
        + ", ".join(f"{r(c)} as {c}" for c in WELCH_SHOWN)
        + f", {r(t_tail_sql('t', 'df'))} as p_value, {r('mean1 - mean2')} as middle, "
        f"0.05::double as outside from ({WELCH})"
    ),
)
def _(spark, folder):
    found = with_welch_p_value(_welch(spark, folder))
    margin = (F.col("conf_high") - F.col("conf_low")) / 2
    found = found.withColumns(
        {
            "middle": (F.col("conf_high") + F.col("conf_low")) / 2,
            "outside": t_p_value(margin / F.col("std_error"), F.col("df")),
        }
    ).drop("conf_low", "conf_high")
    return rounded(found, *WELCH_SHOWN, "p_value", "middle", "outside")


SAMPLE_KEY = "concat_ws('|', 124, incident_id, line, part, supp, cents)"


@register(
    "seeded_sample",
    sql(
        f"select {KEY} from fd where nature in ('1-URGENT', '2-HIGH', '3-MEDIUM') "
        "and is_first = 1 and bad_geocode = 0 and year in ('1996', '1997', '1998') "
        f"order by md5({SAMPLE_KEY}), {KEY} limit 300"
    ),
)
def _(spark, folder):
    from firstdue.operators.spatial import mappable

    rows = mappable(A.responses(spark, folder), A.NATURES, [], first_only=True)
    rows = rows.filter(is_in("year", ["1996", "1997", "1998"]))
    return sampling.seeded_sample(rows.select(*A.RESPONSE_KEY), 300, A.RESPONSE_KEY, 124)
