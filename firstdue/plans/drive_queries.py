"""Checked queries: drive times, calibration and siting scenarios."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from firstdue.constants import CURRENT_SCENARIO, SCENARIOS, STATION_PAIRS
from firstdue.operators import calibration, distributions, drive_times, scenarios
from firstdue.operators.significance import with_fit_p_values
from firstdue.plans import feeds
from firstdue.plans.checks import r, register, rounded, sql, t_tail_sql
from firstdue.plans.siting import nearest_station_table, siting_table
from firstdue.session import work_dir
from firstdue.sources import adapters as A
from firstdue.sources.files import compact_drive_times, read_drive_times, save_drive_times

KEY = ", ".join(A.RESPONSE_KEY)
NEAREST = ["JW_and_FiveFifteen", "JW_and_Lowell", "Union_and_Lowell"]
DIFFERENCES = list(STATION_PAIRS)


# Drive times ------------------------------------------------------------------


@register(
    "distance_json_parse",
    sql(
        f"select addr_id, station, {r('floor(minutes * 60) / 60')} as minutes, "
        f"{r('floor(minutes * 75) / 60')} as minutes_in_traffic from drive_times"
    ),
)
def _(spark, folder):
    parsed = drive_times.parse_answers(A.answers(spark, folder))
    return rounded(parsed, "minutes", "minutes_in_traffic")


@register(
    "drive_time_pending",
    sql(
        "select p.addr_id, p.n, p.destination, s.station, concat('at ', s.station) as origin from "
        "(select addr_id, count(*) as n, replace(min(concat(cast(round(lat, 6) as varchar), ', ', "
        "cast(round(lon, 6) as varchar))), ' ', '') as destination from fd "
        "where is_first = 1 and lon is not null group by addr_id) p "
        f"cross join (select unnest([{', '.join(repr(s) for s in A.STATIONS)}]) as station) s "
        "anti join (select addr_id, station from drive_times "
        "where station in ('HQ', 'Lowell') or (station = 'Teele' and addr_id % 2 = 0)) k "
        "on k.addr_id = p.addr_id and k.station = s.station"
    ),
)
def _(spark, folder):
    times = A.drive_times(spark, folder)
    path = work_dir(spark, "drive_times")
    # As of an interrupted look-up: two stations are complete, one for even addresses, and a
    # station was saved in two parts.
    even = F.col("addr_id") % 2 == 0
    save_drive_times(times.filter(F.col("station").isin("Lowell", "Teele") & even), path)
    save_drive_times(times.filter("station = 'Lowell'").filter(~even), path)
    save_drive_times(times.filter("station = 'HQ'"), path)
    rows = A.responses(spark, folder).filter(
        (F.col("is_first") == 1) & F.col("lon").isNotNull()
    )
    places = rows.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})
    wanted = drive_times.destinations(places, "addr_id")
    names = {s: f"at {s}" for s in A.STATIONS}
    return drive_times.pending_pairs(
        wanted, read_drive_times(spark, path, "addr_id"), "addr_id", names
    ).select("addr_id", "n", "destination", "station", "origin")


@register(
    "drive_time_saves",
    sql(
        f"select addr_id, station, {r('minutes')} as minutes from (select addr_id, station, case "
        "when station = 'HQ' and addr_id % 3 = 0 then minutes + 2 "
        "when station = 'Lowell' and addr_id % 2 = 0 then minutes + 1 else minutes end as minutes "
        "from drive_times where station in ('HQ', 'Lowell') or (station = 'Teele' and addr_id % 2 = 0))"
    ),
)
def _(spark, folder):
    # Two look-ups, the second run twice; all of it compacted; a third one corrects some.
    times = A.drive_times(spark, folder).select("addr_id", "station", "minutes")
    path = work_dir(spark, "drive_times")
    more = lambda n: times.withColumn("minutes", F.col("minutes") + n)
    save_drive_times(times.filter("station in ('HQ', 'Lowell')"), path, 1)
    second = times.filter("station = 'Teele'").union(more(1).filter("station = 'Lowell'"))
    for _ in range(2):
        save_drive_times(second.filter("addr_id % 2 = 0"), path, 2)
    compact_drive_times(spark, path, "addr_id")
    save_drive_times(more(2).filter("station = 'HQ' and addr_id % 3 = 0"), path, 3)
    return rounded(read_drive_times(spark, path, "addr_id"), "minutes").select("addr_id", "station", "minutes")


@register(
    "answer_faults",
    "select vec_id as addr_id, [case when vec_id % 7 = 1 then 'missing' when vec_id % 7 = 2 then 'json' "
    "when vec_id % 7 = 3 then 'rows' else 'duration' end][1] as reason from embeddings "
    "where vec_id % 7 in (1, 2, 3, 4)",
)
def _(spark, folder):
    # Answers of one station, four sevenths of them spoilt in one way each.
    kind = F.col("addr_id") % 7
    body = (
        F.when(kind == 1, "").when(kind == 2, F.substring("body", 1, 30)).when(kind == 3, '{"rows":[]}')
        .when(kind == 4, '{"rows":[{"elements":[{"status":"ZERO_RESULTS"}]}]}').otherwise(F.col("body"))
    )
    landed = A.answers(spark, folder).filter("station = 'HQ'").withColumn("body", body)
    return drive_times.answer_faults(landed).select("addr_id", "reason")


PLAIN = [f"from_{s}" for s in A.STATIONS]
TRAFFIC = [f"from_{s}_in_traffic" for s in A.STATIONS]
SCALED = [f"from_{s}_scaled" for s in A.STATIONS]


def _matrix_sql(columns: list[str]) -> str:
    shown = ", ".join(f"{r(c)} as {c}" for c in columns)
    return sql(f"select {KEY}, addr_id, {shown} from fdg")


@register("drive_time_matrix", _matrix_sql(PLAIN))
def _(spark, folder):
    rows = A.timed_responses(spark, folder).select(*A.RESPONSE_KEY, "addr_id", *PLAIN)
    return rounded(rows, *PLAIN)


@register("drive_time_matrix_traffic", _matrix_sql(PLAIN + TRAFFIC))
def _(spark, folder):
    rows = A.timed_responses(spark, folder, traffic=True)
    return rounded(
        rows.select(*A.RESPONSE_KEY, "addr_id", *PLAIN, *TRAFFIC), *PLAIN, *TRAFFIC
    )


# Calibration ------------------------------------------------------------------


def _best(name: str, pattern: str) -> str:
    return "least(" + ", ".join(pattern.format(s) for s in SCENARIOS[name]) + ")"


def calibrated_views(suffix: str = "") -> list[str]:
    """Views avp, fit and cal: comparison, fitted line, scaled times and scenarios."""
    raw = "from_{}" + suffix
    scaled = "from_{}" + suffix + "_scaled"

    def scale(s: str) -> str:
        x = raw.format(s)
        return (
            f"case when {x} > 4.5 then {x} * 0.82::double else ({x} + 0.0001::double) * "
            f"(fit.intercept + fit.slope * {x}) end as {scaled.format(s)}"
        )

    best = _best(CURRENT_SCENARIO, raw)
    return [
        f"""
avp as (
  select *, actual - predicted as diff, actual / predicted as ratio from (
    select *, first_resp + 0.001::double as actual, {best} + 0.001::double as predicted
    from fdg))""",
        """
trimmed as (
  select * from avp where diff > -3 and diff < 3.5 and ratio > 0.5 and ratio < 2)""",
        """
sums as (
  select regr_count(ratio, predicted)::bigint as n, regr_slope(ratio, predicted) as slope,
    regr_intercept(ratio, predicted) as intercept, regr_r2(ratio, predicted) as r2,
    regr_avgx(ratio, predicted) as mx, regr_sxx(ratio, predicted) as sxx,
    regr_syy(ratio, predicted) as syy, regr_sxy(ratio, predicted) as sxy from trimmed)""",
        """
fit as (
  select *, slope / se_slope as t_slope, intercept / se_intercept as t_intercept,
    pow(slope / se_slope, 2) as f_statistic, sqrt(v) as residual_se from (
    select *, sqrt(v / sxx) as se_slope, sqrt(v * (1.0 / n + mx * mx / sxx)) as se_intercept
    from (select *, (syy - sxy * sxy / sxx) / (n - 2) as v from sums)))""",
        f"""
scaled as (
  select fdg.*, {', '.join(scale(s) for s in A.STATIONS)} from fdg cross join fit)""",
        f"""
cal as (
  select *, first_resp - Union_and_Lowell as residual from (select *,
    {', '.join(f'{_best(name, scaled)} as {name}' for name in SCENARIOS)},
    {', '.join(
        f'{scaled.format(a)} - {scaled.format(b)} as {name}'
        for name, (a, b) in STATION_PAIRS.items()
    )} from scaled))""",
    ]


CAL = calibrated_views()
CAL_TRAFFIC = calibrated_views("_in_traffic")
FIT_COLUMNS = [
    "slope", "intercept", "r2", "se_slope", "se_intercept", "t_slope", "t_intercept",
    "f_statistic", "residual_se",
]
FIT_SQL = "select n, " + ", ".join(f"{r(c)} as {c}" for c in FIT_COLUMNS) + " from fit"
COMPARED = ["actual", "predicted", "diff", "ratio"]
COMPARED_SQL = ", ".join(f"{r(c)} as {c}" for c in COMPARED)


def calibrated(spark, folder, suffix=""):
    """Rows with scaled times, scenario times, differences and residual."""
    return siting_table(
        A.first_responses(spark, folder), A.drive_times(spark, folder), "addr_id", A.STATIONS,
        suffix,
    )


def nearest(spark, folder, suffix=""):
    """Rows with their nearest station."""
    return nearest_station_table(
        A.first_responses(spark, folder), A.drive_times(spark, folder), "addr_id", A.STATIONS,
        suffix,
    )


@register("actual_vs_predicted", sql(f"select {KEY}, {COMPARED_SQL} from avp", *CAL))
def _(spark, folder):
    rows = calibration.actual_vs_predicted(A.timed_responses(spark, folder))
    return rounded(rows.select(*A.RESPONSE_KEY, *COMPARED), *COMPARED)


@register("outlier_trim", sql(f"select {KEY}, {COMPARED_SQL} from trimmed", *CAL))
def _(spark, folder):
    rows = calibration.actual_vs_predicted(A.timed_responses(spark, folder))
    rows = calibration.trim_outliers(rows).select(*A.RESPONSE_KEY, *COMPARED)
    return rounded(rows, *COMPARED)


@register("calibration_fit", sql(FIT_SQL, *CAL))
def _(spark, folder):
    fit = calibration.fit_calibration(A.timed_responses(spark, folder))
    return rounded(fit, *FIT_COLUMNS)


@register("calibration_fit_traffic", sql(FIT_SQL, *CAL_TRAFFIC))
def _(spark, folder):
    rows = A.timed_responses(spark, folder, traffic=True)
    return rounded(calibration.fit_calibration(rows, suffix="_in_traffic"), *FIT_COLUMNS)


@register(
    "calibration_p_value",
    sql(
        FIT_SQL.replace(
            " from fit",
            f", {r(t_tail_sql('t_intercept', 'cast(n - 2 as double)'))} as p_intercept, "
            f"{r(t_tail_sql('t_slope', 'cast(n - 2 as double)'))} as p_slope from fit",
        ),
        *CAL,
    ),
)
def _(spark, folder):
    fit = calibration.fit_calibration(A.timed_responses(spark, folder))
    return rounded(with_fit_p_values(fit), *FIT_COLUMNS, "p_intercept", "p_slope")


@register(
    "calibrated_time",
    sql(
        f"select {KEY}, " + ", ".join(f"{r(c)} as {c}" for c in SCALED) + " from scaled", *CAL
    ),
)
def _(spark, folder):
    return rounded(calibrated(spark, folder).select(*A.RESPONSE_KEY, *SCALED), *SCALED)


RESIDUAL = ["actual", "predicted", "diff", "ratio", "residual"]


@register(
    "calibrated_residual",
    sql(
        f"select {KEY}, {r('first_resp + 0.001::double')} as actual, "
        f"{r('Union_and_Lowell + 0.001::double')} as predicted, "
        f"{r('(first_resp + 0.001::double) - (Union_and_Lowell + 0.001::double)')} as diff, "
        f"{r('(first_resp + 0.001::double) / (Union_and_Lowell + 0.001::double)')} as ratio, "
        f"{r('residual')} as residual from cal",
        *CAL,
    ),
)
def _(spark, folder):
    return rounded(calibrated(spark, folder).select(*A.RESPONSE_KEY, *RESIDUAL), *RESIDUAL)


SUMMARY = ["min", "q1", "median", "mean", "q3", "max"]


def _summary_sql(value: str, source: str, key: str | None = None) -> str:
    keys = f"{key}, " if key else ""
    group = f" group by {key}" if key else ""
    return (
        f"select {keys}{r(f'min({value})')} as min, {r(f'quantile_cont({value}, 0.25)')} as q1, "
        f"{r(f'quantile_cont({value}, 0.5)')} as median, {r(f'avg({value})')} as mean, "
        f"{r(f'quantile_cont({value}, 0.75)')} as q3, {r(f'max({value})')} as max, "
        f"count(*) filter ({value} is null) as n_missing from {source}{group}"
    )


def _register_summaries(suffix: str, views: list[str]) -> None:
    tag = "_traffic" if suffix else ""

    @register(f"ratio_summary{tag}", sql(
        _summary_sql(
            "d", "(select Union_and_Lowell / first_resp as d from cal "
            "where Union_and_Lowell / nullif(first_resp, 0) < 3)"
        ), *views
    ))
    def _(spark, folder):
        rows = calibration.ratio_without_outliers(calibrated(spark, folder, suffix), CURRENT_SCENARIO)
        return rounded(distributions.six_number_summary(rows.select("diff"), "diff"), *SUMMARY)

    @register(f"six_number_summary{tag}", sql(_summary_sql("residual", "cal"), *views))
    def _(spark, folder):
        rows = calibrated(spark, folder, suffix)
        return rounded(distributions.six_number_summary(rows, "residual"), *SUMMARY)


_register_summaries("", CAL)
_register_summaries("_in_traffic", CAL_TRAFFIC)


@register("longitude_summary", sql(_summary_sql("lon", "fd")))
def _(spark, folder):
    # All rows as one group, a part of them missing.
    rows = A.responses(spark, folder)
    return rounded(distributions.six_number_summary(rows, "lon"), *SUMMARY)


def _register_unit_tables(suffix: str, views: list[str]) -> None:
    tag = "_traffic" if suffix else ""

    @register(
        f"summary_by_unit{tag}",
        sql(_summary_sql("JW_v_FiveFifteen", "cal where unit in ('U1', 'U3')", "unit"), *views),
    )
    def _(spark, folder):
        rows = calibrated(spark, folder, suffix).filter(F.col("unit").isin("U1", "U3"))
        summary = distributions.six_number_summary(rows, "JW_v_FiveFifteen", ["unit"])
        return rounded(summary, *SUMMARY)

    @register(
        f"histogram_auto{tag}",
        sql(
            f"""
    select cast(k.bin as bigint) as bin, {r('(first + k.bin - 1) * unit')} as lower,
      {r('(first + k.bin) * unit')} as upper, coalesce(c.n, 0) as n
    from (select unnest(range(1, cast(last - first as bigint) + 1)) as bin, * from rule) k
    left join (
      select greatest(ceil(x / unit - 1e-7::double) - first, 1) as bin, count(*) as n
      from v cross join rule group by 1) c on c.bin = k.bin""",
            *views,
            "v as (select JW_v_FiveFifteen as x from cal where unit = 'U3')",
            """
    lim as (
      select min(x) as lo, max(x) as hi,
        (max(x) - min(x)) / ceil(log2(count(*)) + 1) as cell from v)""",
            "b as (select *, pow(10, floor(log10(cell))) as base from lim)",
            """
    rule as (
      select unit, floor(lo / unit + 1e-10::double) as first,
        ceil(hi / unit - 1e-10::double) as last from (
        select *, base * case when not (2*base - cell < 1.5*(cell - base)) then 1
          when not (5*base - cell < 2.75*(cell - 2*base)) then 2
          when not (10*base - cell < 1.5*(cell - 5*base)) then 5 else 10 end as unit from b))""",
        ),
    )
    def _(spark, folder):
        rows = calibrated(spark, folder, suffix).filter(F.col("unit") == "U3")
        return rounded(distributions.auto_histogram(rows, "JW_v_FiveFifteen"), "lower", "upper")


_register_unit_tables("", CAL)
_register_unit_tables("_in_traffic", CAL_TRAFFIC)


# Scenarios --------------------------------------------------------------------


@register(
    "scenario_best_time",
    sql(
        f"select {KEY}, " + ", ".join(f"{r(s)} as {s}" for s in SCENARIOS) + " from cal", *CAL
    ),
)
def _(spark, folder):
    names = list(SCENARIOS)
    return rounded(calibrated(spark, folder).select(*A.RESPONSE_KEY, *names), *names)


@register(
    "station_difference",
    sql(
        f"select {KEY}, " + ", ".join(f"{r(d)} as {d}" for d in DIFFERENCES) + " from cal", *CAL
    ),
)
def _(spark, folder):
    rows = calibrated(spark, folder).select(*A.RESPONSE_KEY, *DIFFERENCES)
    return rounded(rows, *DIFFERENCES)


@register(
    "scenario_best_time_traffic",
    sql(
        f"select {KEY}, "
        + ", ".join(f"{r(c)} as {c}" for c in [*SCENARIOS, *DIFFERENCES, "residual"])
        + " from cal",
        *CAL_TRAFFIC,
    ),
)
def _(spark, folder):
    names = [*SCENARIOS, *DIFFERENCES, "residual"]
    rows = calibrated(spark, folder, "_in_traffic")
    return rounded(rows.select(*A.RESPONSE_KEY, *names), *names)


def _nearest_sql(name: str, suffix: str = "") -> str:
    columns = [f"from_{s}{suffix}" for s in SCENARIOS[name]]
    low, high = f"least({', '.join(columns)})", f"greatest({', '.join(columns)})"
    named = ", ".join(
        f"case when {c} <= {low} + 0.00001::double * {high} then '{s}' end"
        for s, c in zip(SCENARIOS[name], columns, strict=True)
    )
    return f"least({named}) as station_{name}"


NEAREST_SQL = ", ".join(_nearest_sql(n) for n in NEAREST)


@register(
    "nearest_station",
    sql(f"select {KEY}, {r('lon')} as lon, {r('lat')} as lat, {NEAREST_SQL} from fdg"),
)
def _(spark, folder):
    points = feeds.nearest_map(nearest(spark, folder), NEAREST, A.RESPONSE_KEY)
    return rounded(points, "lon", "lat")


@register(
    "nearest_station_traffic",
    sql(
        f"select {KEY}, "
        + ", ".join(_nearest_sql(n, "_in_traffic") for n in NEAREST)
        + " from fdg"
    ),
)
def _(spark, folder):
    rows = nearest(spark, folder, "_in_traffic")
    return rows.select(*A.RESPONSE_KEY, *[f"station_{s}" for s in NEAREST])


@register(
    "nearest_station_share",
    sql(
        "select scenario, station, count(*) as n, "
        f"{r('count(*) / (sum(count(*)) over (partition by scenario))')} as share "
        "from labels group by scenario, station",
        f"near as (select {NEAREST_SQL} from fdg)",
        "labels as ("
        + " union all ".join(
            f"select '{n}' as scenario, station_{n} as station from near" for n in NEAREST
        )
        + ")",
    ),
)
def _(spark, folder):
    share = scenarios.nearest_station_share(nearest(spark, folder), NEAREST)
    return rounded(share, "share")


# Per-address feeds --------------------------------------------------------------

#: Addresses of the test tables have an id besides their text.
ADDRESS = {"address": ("addr_id", "full_address")}
POINT = "min_by(lon, incident_id) as lon, min_by(lat, incident_id) as lat"
POINT_COLUMNS = f"{r('lon')} as lon, {r('lat')} as lat"


def _flag(value: str, limit: float = 5) -> str:
    return f"case when {value} > {limit} then 'No' when {value} <= {limit} then 'Yes' end"


def _band(value: str) -> str:
    return (
        f"case when {value} > 0 and {value} <= 2 then '0-2' "
        f"when {value} > 2 and {value} <= 4 then '2-4' "
        f"when {value} > 4 and {value} <= 5 then '4-5' when {value} is not null then '5 +' end"
    )


def _address_sql(values, shown: str, where="true", source="cal", views=CAL) -> str:
    means = ", ".join(f"avg({v}) as {v}" for v in values)
    return sql(
        f"select addr_id, n, {POINT_COLUMNS}, {shown} from (select addr_id, full_address, "
        f"count(*) as n, {means}, {POINT} from {source} where {where} "
        "group by addr_id, full_address)",
        *views,
    )


def _shown(df, *values: str, flags: tuple[str, ...] = ()):
    return rounded(df.select("addr_id", "n", "lon", "lat", *values, *flags), "lon", "lat", *values)


@register(
    "address_scenario_mean",
    _address_sql(SCENARIOS, ", ".join(f"{r(s)} as {s}" for s in SCENARIOS)),
)
def _(spark, folder):
    return _shown(feeds.address_means(calibrated(spark, folder), list(SCENARIOS), **ADDRESS), *SCENARIOS)


@register(
    "address_scenario_mean_traffic",
    _address_sql(SCENARIOS, ", ".join(f"{r(s)} as {s}" for s in SCENARIOS), views=CAL_TRAFFIC),
)
def _(spark, folder):
    rows = calibrated(spark, folder, "_in_traffic")
    return _shown(feeds.address_means(rows, list(SCENARIOS), **ADDRESS), *SCENARIOS)


def _register_scenario_flags(suffix: str, views: list[str]) -> None:
    tag = "_traffic" if suffix else ""
    address_sql = partial(_address_sql, views=views)

    @register(
        f"minutes_band{tag}",
        address_sql(["JW_and_Lowell"], f"{_band('JW_and_Lowell')} as band"),
    )
    def _(spark, folder):
        out = feeds.scenario_map(calibrated(spark, folder, suffix), "JW_and_Lowell", **ADDRESS)
        return _shown(out, flags=("band",))

    @register(
        f"under_five_flag{tag}",
        address_sql(
            ["FiveFifteen_alone"],
            f"{r('FiveFifteen_alone')} as minutes, {_flag('FiveFifteen_alone')} as under_five",
        ),
    )
    def _(spark, folder):
        out = feeds.scenario_map(calibrated(spark, folder, suffix), "FiveFifteen_alone", **ADDRESS)
        out = out.withColumnRenamed("FiveFifteen_alone", "minutes")
        return _shown(out, "minutes", flags=("under_five",))


_register_scenario_flags("", CAL)
_register_scenario_flags("_in_traffic", CAL_TRAFFIC)


@register(
    "address_actual_mean",
    _address_sql(
        ["first_resp"], f"{r('first_resp')} as first_resp, {_flag('first_resp')} as under_five"
    ),
)
def _(spark, folder):
    # The actual time needs no drive times beyond the rows that have them.
    out = feeds.actual_map(A.timed_responses(spark, folder), **ADDRESS)
    return _shown(out, "first_resp", flags=("under_five",))


def _register_differences(suffix: str, views: list[str]) -> None:
    tag = "_traffic" if suffix else ""
    address_sql = partial(_address_sql, views=views)

    @register(
        f"address_station_difference{tag}",
        address_sql(
            ["JW_v_FiveFifteen", "JW_v_Lowell"],
            f"{r('JW_v_FiveFifteen')} as JW_v_FiveFifteen, {r('JW_v_Lowell')} as JW_v_Lowell",
            "unit = 'U3'",
        ),
    )
    def _(spark, folder):
        values = ["JW_v_FiveFifteen", "JW_v_Lowell"]
        return _shown(feeds.address_means(calibrated(spark, folder, suffix), values, **ADDRESS, unit="U3"), *values)

    @register(
        f"address_station_difference_all{tag}",
        address_sql(["FiveFifteen_v_Lowell"], f"{r('FiveFifteen_v_Lowell')} as difference"),
    )
    def _(spark, folder):
        out = feeds.difference_map(calibrated(spark, folder, suffix), "FiveFifteen_v_Lowell", **ADDRESS)
        return _shown(out.withColumnRenamed("FiveFifteen_v_Lowell", "difference"), "difference")

    @register(
        f"address_hq_difference{tag}",
        address_sql(["HQ_v_Lowell"], f"{r('HQ_v_Lowell')} as difference", "unit = 'U1'"),
    )
    def _(spark, folder):
        out = feeds.difference_map(calibrated(spark, folder, suffix), "HQ_v_Lowell", **ADDRESS, unit="U1")
        return _shown(out.withColumnRenamed("HQ_v_Lowell", "difference"), "difference")

    @register(
        f"faster_flag{tag}",
        address_sql(
            ["FiveFifteen_v_Lowell"],
            f"{r('FiveFifteen_v_Lowell')} as difference, "
            f"{_flag('FiveFifteen_v_Lowell', 0)} as faster",
            "unit = 'U1'",
        ),
    )
    def _(spark, folder):
        out = feeds.difference_map(calibrated(spark, folder, suffix), "FiveFifteen_v_Lowell", **ADDRESS, unit="U1")
        out = out.withColumnRenamed("FiveFifteen_v_Lowell", "difference")
        return _shown(out, "difference", flags=("faster",))


_register_differences("", CAL)
_register_differences("_in_traffic", CAL_TRAFFIC)


def _raw_time(name: str, column: str, unit: str):
    @register(
        name,
        _address_sql(
            [column],
            f"{r(column)} as minutes, {_flag(column)} as under_five",
            f"unit = '{unit}'",
            "fdg",
        ),
    )
    def _(spark, folder):
        out = feeds.raw_time_map(A.timed_responses(spark, folder), column, unit, **ADDRESS)
        return _shown(
            out.withColumnRenamed(column, "minutes"), "minutes", flags=("under_five",)
        )


_raw_time("address_raw_time", "from_Lowell", "U3")
_raw_time("address_raw_time_hq", "from_HQ", "U1")
_raw_time("address_raw_time_jw", "from_JoyWashington", "U3")


def _register_residuals(suffix: str, views: list[str]) -> None:
    tag = "_traffic" if suffix else ""
    address_sql = partial(_address_sql, views=views)

    @register(
        f"address_residual{tag}",
        address_sql(["residual"], f"{r('residual')} as residual"),
    )
    def _(spark, folder):
        return _shown(feeds.address_means(calibrated(spark, folder, suffix), ["residual"], **ADDRESS), "residual")

    @register(
        f"scale_censor{tag}",
        address_sql(
            ["residual"], f"{r('case when residual between -3 and 3 then residual end')} as residual"
        ),
    )
    def _(spark, folder):
        from firstdue.functions.labels import censor

        out = feeds.address_means(calibrated(spark, folder, suffix), ["residual"], **ADDRESS)
        return _shown(out.withColumn("residual", censor(F.col("residual"), -3, 3)), "residual")


_register_residuals("", CAL)
_register_residuals("_in_traffic", CAL_TRAFFIC)
