"""Registry of checked queries and the SQL views their checks share.

A query is registered with the SQL that gives the same table from the raw
tables, or without where SQL has no counterpart. Doubles are rounded in both:
first to 12 places, which removes the last-digit noise of differently ordered
sums, then to the places shown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstdue.session import tune
from firstdue.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return query(tune(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return query

    return keep


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round the named double columns, keep the others."""
    return df.withColumns({c: F.round(F.round(F.col(c), 12), places) for c in columns})


def r(expression: str, places: int = 6) -> str:
    return f"cast(round(cast({expression} as decimal(38, 12)), {places}) as double)"


def t_tail_sql(t: str, df: str, steps: int = 20_000) -> str:
    """Two-sided probability of a t statistic: Simpson's rule on its density from 0 to its size."""
    at = f"(abs({t}) * i / {steps})"
    weight = f"(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end)"
    density = f"pow(1 + {at} * {at} / {df}, -({df} + 1) / 2)"
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    area = (
        f"(select sum({weight} * {density}) from range({steps + 1}) as s(i)) "
        f"* abs({t}) / {steps} / 3 * {scale}"
    )
    return f"greatest(1 - 2 * {area}, 0)"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def count_col() -> Column:
    return F.count(F.lit(1)).alias("n")


_TIMES = " union all ".join(
    f"select vec_id as addr_id, '{s}' as station, 2 + 10*abs(cast(embedding[{k}] as double)) "
    "as minutes from embeddings"
    for k, s in enumerate(adapters.STATIONS, start=3)
)
_WIDE = ", ".join(
    f"max(case when station = '{s}' then minutes end) as from_{s}, "
    f"max(case when station = '{s}' then minutes_in_traffic end) as from_{s}_in_traffic"
    for s in adapters.STATIONS
)

VIEWS = f"""
ust as (
  select l_orderkey as incident_id, concat('U', cast(l_suppkey % 8 as varchar)) as unit,
    o_orderpriority as nature, strftime(o_orderdate, '%Y') as year,
    cast(o_orderdate as date) as date_short, o_custkey as addr_id,
    l_extendedprice / 10000 as resp_time, l_linenumber as line, l_partkey as part,
    l_suppkey as supp, cast(round(l_extendedprice * 100) as bigint) as cents
  from lineitem join orders on l_orderkey = o_orderkey),
onloc as (
  select l_orderkey as incident_id, concat('U', cast(l_suppkey % 8 as varchar)) as unit,
    l_extendedprice / 10000 as resp_time, l_linenumber as line, l_partkey as part,
    l_suppkey as supp from lineitem),
geo as (
  select vec_id as addr_id,
    concat(cast(vec_id as varchar), ' MAIN ST{adapters.TOWN}') as full_address,
    -71.10 + 0.1 * cast(embedding[1] as double) as lon,
    42.3875 + 0.1 * cast(embedding[2] as double) as lat from embeddings),
drive_times as (
  select addr_id, station, minutes, minutes * 1.25 as minutes_in_traffic from ({_TIMES})),
wide as (select addr_id, {_WIDE} from drive_times group by addr_id),
first_arrival as (
  select incident_id, unit as first_unit, resp_time as first_resp from (
    select *, row_number() over (partition by incident_id
      order by resp_time, unit, line, part, supp) as rn from onloc) where rn = 1),
fd as (
  select u.*, f.first_unit, f.first_resp, g.full_address, g.lon, g.lat,
    case when f.first_unit = u.unit then 1 else 0 end as is_first,
    case when g.full_address is null then 1 when g.lat < 42.37 then 1
      when g.lat is not null and g.lon is not null then 0 end as bad_geocode
  from ust u left join first_arrival f on f.incident_id = u.incident_id
  left join geo g on g.addr_id = u.addr_id),
critical as (
  select * from fd where is_first = 1 and nature in ({quoted(adapters.NATURES)})),
mapped as (
  select * from fd where bad_geocode = 0 and nature in ({quoted(adapters.NATURES)})
    and lon is not null),
fdg as (
  select fd.*, wide.* exclude (addr_id) from fd join wide on wide.addr_id = fd.addr_id
  where fd.is_first = 1)
"""


def sql(body: str, *ctes: str) -> str:
    """A statement over the shared views and further common tables."""
    return "with " + ", ".join([VIEWS.strip(), *[c.strip() for c in ctes]]) + "\n" + body
