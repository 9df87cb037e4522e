"""Checked queries: points, grids and density surfaces for maps."""

from __future__ import annotations

from firstdue.operators import density, spatial
from firstdue.plans.checks import r, register, rounded, sql
from firstdue.sources import adapters as A

KEY = ", ".join(A.RESPONSE_KEY)
NODES = 25


def _mapped(spark, folder, **options):
    return spatial.mappable(A.responses(spark, folder), A.NATURES, [], **options)


# Points -----------------------------------------------------------------------


def _points_sql(where: str) -> str:
    return sql(
        f"select incident_id, {r('min(lon)')} as lon, {r('min(lat)')} as lat, "
        f"min(year) as year from mapped where {where} group by incident_id"
    )


@register("incident_points", _points_sql("true"))
def _(spark, folder):
    return rounded(spatial.incident_points(_mapped(spark, folder)), "lon", "lat")


@register(
    "incident_points_over5", _points_sql("is_first = 1 and first_resp > 5 and year <> '1995'")
)
def _(spark, folder):
    rows = _mapped(spark, folder, first_only=True, over_minutes=5, without_year="1995")
    return rounded(spatial.incident_points(rows), "lon", "lat")


@register(
    "over5_points",
    sql(
        f"select {KEY}, year, {r('lon')} as lon, {r('lat')} as lat from mapped "
        "where is_first = 1 and first_resp > 5"
    ),
)
def _(spark, folder):
    rows = _mapped(spark, folder, first_only=True, over_minutes=5)
    return rounded(rows.select(*A.RESPONSE_KEY, "year", "lon", "lat"), "lon", "lat")


@register(
    "dot_points",
    sql(
        f"select {r('lon')} as lon, {r('lat')} as lat, "
        f"{r('quantile_cont(first_resp, 0.5)')} as median, count(*) as n from mapped "
        "where is_first = 1 and year = '2000' group by mapped.lon, mapped.lat"
    ),
)
def _(spark, folder):
    rows = _mapped(spark, folder, first_only=True, only_year="2000")
    return rounded(spatial.dot_points(rows), "lon", "lat", "median")


# Grids ------------------------------------------------------------------------


def _grid_sql(stat: str, facet: str | None = None, where: str = "true") -> str:
    keys = f"{facet}, " if facet else ""
    return sql(
        f"select {keys}cell_x, cell_y, {r(stat)} as stat, count(*) as n, "
        f"{r('(cell_x + 0.5::double) * 0.002::double')} as lon, "
        f"{r('(cell_y + 0.5::double) * 0.002::double')} as lat from cells "
        f"group by {keys}cell_x, cell_y",
        f"""
cells as (
  select year, first_resp,
    cast(greatest(ceil(lon / 0.002::double - 1e-8::double) - 1,
      floor(min(lon) over () / 0.002::double + 1e-8::double)) as bigint) as cell_x,
    cast(greatest(ceil(lat / 0.002::double - 1e-8::double) - 1,
      floor(min(lat) over () / 0.002::double + 1e-8::double)) as bigint) as cell_y
  from mapped where is_first = 1 and {where})""",
    )


def _grid(spark, folder, stat, facet=None, **options):
    rows = _mapped(spark, folder, first_only=True, **options)
    return rounded(spatial.grid_summary(rows, stat, facet=facet), "stat", "lon", "lat")


@register("grid_median", _grid_sql("quantile_cont(first_resp, 0.5)"))
def _(spark, folder):
    return _grid(spark, folder, "median")


@register("grid_p90", _grid_sql("quantile_cont(first_resp, 0.9)"))
def _(spark, folder):
    return _grid(spark, folder, 0.9)


@register(
    "grid_p90_by_year", _grid_sql("quantile_cont(first_resp, 0.9)", "year", "year <> '1995'")
)
def _(spark, folder):
    return _grid(spark, folder, 0.9, "year", without_year="1995")


@register("grid_mean", _grid_sql("avg(first_resp)"))
def _(spark, folder):
    return _grid(spark, folder, "mean")


def _one_pass_sql() -> str:
    def part(grid, year, keys, where):
        return (
            f"select '{grid}' as grid, {year} as year, cell_x, cell_y, {r('quantile_cont(first_resp, 0.5)')} as median, "
            f"{r('quantile_cont(first_resp, 0.9)')} as p90, {r('avg(first_resp)')} as mean, count(*) as n, "
            f"{r('(cell_x + 0.5::double) * 0.002::double')} as lon, "
            f"{r('(cell_y + 0.5::double) * 0.002::double')} as lat from cells where {where} group by {keys}cell_x, cell_y"
        )

    body = part("all", "null", "", "true") + " union all " + part("year", "year", "year, ", "true")
    return _grid_sql("avg(first_resp)").rsplit("\nselect", 1)[0] + "\n" + body


@register("grid_statistics", _one_pass_sql())
def _(spark, folder):
    # The four maps above from one call: their statistics, over all years and by year.
    rows = _mapped(spark, folder, first_only=True)
    stats = {"median": "median", "p90": 0.9, "mean": "mean"}
    out = spatial.grid_statistics(rows, stats, [None, "year"])
    return rounded(out, *stats, "lon", "lat")


# Density ----------------------------------------------------------------------


def _density_views(source: str, by_year: bool) -> list[str]:
    keys = "year, " if by_year else ""
    group = " group by year" if by_year else ""
    same = " and p.year = w.year" if by_year else ""

    def width(c: str) -> str:
        iqr = f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.34"
        return f"1.06 * least(stddev_samp({c}), {iqr}) * pow(count(*), -0.2)"

    return [
        f"src as ({source})",
        f"pts as (select {keys}lon, lat, count(*) as c from src group by all)",
        f"w as (select {keys}count(*) as n, {width('lon')} as sx, {width('lat')} as sy "
        f"from src{group})",
        """
nodes as (
  select i.range as ix, j.range as iy, x0 + i.range * ((x1 - x0) / 24) as gx,
    y0 + j.range * ((y1 - y0) / 24) as gy
  from (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from src),
    range(25) i, range(25) j)""",
        f"""
dens as (
  select {'w.year, ' if by_year else ''}ix, iy, min(gx) as lon, min(gy) as lat,
    sum(c * exp(-0.5 * pow((gx - p.lon) / sx, 2)) * exp(-0.5 * pow((gy - p.lat) / sy, 2)))
      / (2 * pi() * min(n) * min(sx) * min(sy)) as density
  from nodes, pts p, w where true{same} group by {'w.year, ' if by_year else ''}ix, iy)""",
    ]


RUNS = "select lon, lat from mapped"
CALLS_BY_YEAR = (
    "select min(year) as year, min(lon) as lon, min(lat) as lat from mapped "
    "where year <> '1995' group by incident_id"
)
SHOWN = (
    f"cast(ix as integer) as ix, cast(iy as integer) as iy, {r('lon')} as lon, "
    f"{r('lat')} as lat, {r('density', 3)} as density"
)


def _shown(df):
    return rounded(rounded(df, "lon", "lat"), "density", places=3)


@register("density_grid", sql(f"select {SHOWN} from dens", *_density_views(RUNS, False)))
def _(spark, folder):
    return _shown(density.density_grid(_mapped(spark, folder), NODES))


@register(
    "density_grid_by_year",
    sql(f"select year, {SHOWN} from dens", *_density_views(CALLS_BY_YEAR, True)),
)
def _(spark, folder):
    calls = spatial.incident_points(_mapped(spark, folder, without_year="1995"))
    return _shown(density.density_grid(calls, NODES, "year"))


CALLS = "select min(lon) as lon, min(lat) as lat from mapped group by incident_id"
OVER5_BY_YEAR = (
    "select min(year) as year, min(lon) as lon, min(lat) as lat from mapped "
    "where year <> '1995' and is_first = 1 and first_resp > 5 group by incident_id"
)


@register("density_calls", sql(f"select {SHOWN} from dens", *_density_views(CALLS, False)))
def _(spark, folder):
    calls = spatial.incident_points(_mapped(spark, folder))
    return _shown(density.density_grid(calls, NODES))


@register(
    "density_over5_by_year",
    sql(f"select year, {SHOWN} from dens", *_density_views(OVER5_BY_YEAR, True)),
)
def _(spark, folder):
    rows = _mapped(spark, folder, first_only=True, over_minutes=5, without_year="1995")
    return _shown(density.density_grid(spatial.incident_points(rows), NODES, "year"))


@register(
    "density_bands",
    sql(
        "select cast(ix as integer) as ix, cast(iy as integer) as iy, cast(least(16, "
        "floor(16 * density / max(density) over ()) + 1) as integer) as band from dens",
        *_density_views(
            "select min(lon) as lon, min(lat) as lat from mapped where is_first = 1 "
            "and first_resp > 5 group by incident_id",
            False,
        ),
    ),
)
def _(spark, folder):
    rows = _mapped(spark, folder, first_only=True, over_minutes=5)
    grid = density.density_grid(spatial.incident_points(rows), NODES)
    return density.density_bands(grid).select("ix", "iy", "band")
