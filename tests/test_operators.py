"""Operators on hand-made rows, properties and skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firstdue import constants
from firstdue.operators import (
    calibration, columns, density, distributions, drive_times, geocoding, indicators, responses,
    quantiles, sampling, scenarios, spatial,
)
from firstdue.operators.quantiles import group_quantiles
from firstdue.plans import feeds


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Responses --------------------------------------------------------------------


def test_first_arrival_ties_and_missing(spark):
    df = spark.createDataFrame(
        [(1, "E2", 3.0), (1, "E1", 3.0), (1, "E9", None), (2, "E5", None), (2, "E6", 9.0)],
        "incident_id long, unit string, resp_time double",
    )
    got = rows(responses.first_arrivals(df), "incident_id")
    assert got == [(1, "E1", 3.0), (2, "E6", 9.0)]


def test_responses_keep_every_row_and_trim_the_flag(spark):
    activity = spark.createDataFrame(
        [("a", "E1 "), ("a", "E2"), (" b", "E3"), ("c", "E4"), ("c", "E4")],
        "incident_id string, unit string",
    )
    arrivals = spark.createDataFrame(
        [("a", "E1", 2.0), ("b", " E3", 1.0), ("c", "E4", 4.0), ("c", "E5", 5.0)],
        "incident_id string, unit string, resp_time double",
    )
    places = spark.createDataFrame([("a", 1.0)], "incident_id string, lon double")
    out = responses.build_responses(activity, arrivals, places)
    got = rows(out.select("incident_id", "unit", "first_resp", "is_first", "lon"), "unit")
    # " b" is flagged on trimmed keys but not joined, as its key differs.
    assert got == [
        ("a", "E1 ", 2.0, 1, 1.0), ("a", "E2", 2.0, 0, 1.0), (" b", "E3", None, 1, None),
        ("c", "E4", 4.0, 1, None), ("c", "E4", 4.0, 1, None),
    ]


def test_hot_incident_is_split_over_tasks(spark, tmp_path):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k) for k in small}
    ids = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20000).cast("long")
    activity = spark.range(0, 300000, 1, 8).select(
        ids.alias("incident_id"), F.lit("E1").alias("unit"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"),
    )
    activity.write.parquet(str(tmp_path / "activity"))
    activity = spark.read.parquet(str(tmp_path / "activity"))
    arrivals = activity.select("incident_id", "unit", F.lit(1.0).alias("resp_time"))
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        joined = responses.with_first_arrival(activity, responses.first_arrivals(arrivals))
        out = joined.agg(F.count(F.lit(1)), F.sum("is_first"), F.max("note"))
        assert out.collect()[0][:2] == (300000, 300000)
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Quantiles --------------------------------------------------------------------


def test_quantiles_are_exact(spark):
    draw = random.Random(5)
    data = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else draw.choice(["a", "b", None])
        value = draw.choice(
            [None, 0.0, draw.gauss(0, 1e-3), draw.gauss(5, 2), draw.lognormvariate(0, 9), -4.0]
        )
        data.append((group, value))
    data += [("none", None), ("one", 2.5), ("two", 1.0), ("two", 4.0)]
    data += [("power", float(2**k)) for k in range(-5, 6)]
    df = spark.createDataFrame(data, "k string, x double")
    shares = {"lo": 0.0, "q1": 0.25, "med": 0.5, "p90": 0.9, "hi": 1.0}
    expected = {}
    for group in {g for g, _ in data}:
        x = np.array([v for g, v in data if g == group and v is not None])
        expected[group] = [float(np.quantile(x, p)) if len(x) else None for p in shares.values()]
    out = group_quantiles(df, ["k"], "x", shares)
    got = {r[0]: list(r)[1:] for r in out.collect()}
    assert got.keys() == expected.keys()
    for group, values in expected.items():
        if None in values:
            assert got[group] == values
        else:
            assert got[group] == pytest.approx(values, rel=1e-12), group
    total = [float(np.quantile([v for _, v in data if v is not None], p)) for p in (0.5, 0.9)]
    extra = {"c": "rows", "none": "missing", "a": "mean", "low": "min", "high": "max"}
    out = group_quantiles(df, [], "x", {"m": 0.5, "n": 0.9}, extra).collect()[0]
    assert list(out)[:2] == pytest.approx(total, rel=1e-12) and out["c"] == len(data)
    known = [v for _, v in data if v is not None]
    assert out["none"] == len(data) - len(known)
    assert (out["low"], out["high"]) == (min(known), max(known))
    assert out["a"] == pytest.approx(sum(known) / len(known))


def test_quantiles_of_nan_and_infinity(spark):
    # NaN is missing; infinity is the largest value.
    values = [1.0, 2.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = group_quantiles(df, [], "x", {"m": 0.5, "p": 0.9}, {"gone": "missing"}).collect()[0]
    assert tuple(out) == (2.0, float("inf"), 1)


def test_quantiles_of_many_groups(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"), (F.col("id") * 0.5).alias("x"))
    out = group_quantiles(df, ["k"], "x", {"m": 0.5})
    wrong = out.filter(F.abs(F.col("m") - (F.col("k") * 0.5 + 3750)) > 1e-9)
    assert out.count() == 5000 and wrong.count() == 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def shuffles(plan):
    """Exchanges that ran, without those whose result is used again."""
    return sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.splitlines())


@pytest.mark.parametrize("keys", [["l_suppkey"], []])
def test_quantiles_shuffle_the_rows_once(spark, folder, keys):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    final = final_plan(group_quantiles(rows, keys, "l_extendedprice", {"m": 0.5}, {"n": "rows"}))
    assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 1
    # Counting, laying out in buckets, totals of buckets by group; several quantiles are then put in a row.
    assert shuffles(final) <= 3
    many = {"a": 0.1, "b": 0.5, "c": 0.9}
    assert shuffles(final_plan(group_quantiles(rows, keys, "l_extendedprice", many))) <= 4


def test_a_group_with_most_of_the_rows_is_spread(spark):
    """Of one hot group no task gets a large part, whether its values differ or not."""
    x = F.when(F.col("id") % 3 == 0, F.lit(4.0)).otherwise(F.exp(F.col("id") % 9973 / 2000))
    df = spark.range(0, 120_000, 1, 8).select(F.lit("hot").alias("k"), x.alias("x"))
    out = group_quantiles(df, ["k"], "x", {"m": 0.5, "p": 0.9}, {"n": "rows"})
    values = np.where(np.arange(120_000) % 3 == 0, 4.0, np.exp(np.arange(120_000) % 9973 / 2000))
    assert rows(out)[0] == ("hot", pytest.approx(np.quantile(values, 0.5), rel=1e-12),
                            pytest.approx(np.quantile(values, 0.9), rel=1e-12), 120_000)
    counted = df.groupBy("k", "x").count()
    laid = counted.withColumn("b", quantiles._bucket(F.col("x"))).repartition(16, "k", "b")
    sizes = [r[0] for r in laid.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_quantile_weights_and_na_policy(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2), ("a", 2.0, 1), ("a", 10.0, 1), ("b", 1.0, 1), ("b", None, 3)],
        "k string, x double, w int",
    )
    out = group_quantiles(df, ["k"], "x", {"m": 0.5}, weight="w")
    assert rows(out, "k") == [("a", 1.5), ("b", 1.0)]
    out = group_quantiles(df, ["k"], "x", {"m": 0.5}, weight="w", na="propagate")
    assert rows(out, "k") == [("a", 1.5), ("b", None)]
    assert group_quantiles(df, [], "x", {"p": 0.9}).collect()[0]["p"] > 7


def test_known_p90(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    out = group_quantiles(df, [], "x", {"p": 0.9})
    assert out.collect()[0]["p"] == pytest.approx(7.9)


# Indicators and distributions ---------------------------------------------------


def test_runs_per_day(spark):
    data = [
        (1, "E1", "d1", "FIRE", "2009"), (1, "E1", "d1", "FIRE", "2009"),
        (2, "E1", "d1", "FIRE", "2009"), (3, "E1", "d2", "FIRE", "2009"),
        (4, "E1", "d3", "TRAINING", "2009"), (5, "E1", "d9", "FIRE", "2015"),
        (6, "", "d9", "FIRE", "2015"), (7, "E2", "d9", "FIRE", "2009"),
    ]
    df = spark.createDataFrame(
        data, "incident_id long, unit string, date_short string, nature string, year string"
    )
    out = indicators.avg_runs_per_day(df, ["2009", "2015"], "2009", "2015", "TRAINING")
    assert [tuple(r) for r in out.collect()] == [
        ("E1", 1.5, 1.0, pytest.approx(-1 / 3)), ("E2", 1.0, None, None),
    ]


def test_exceedance_drops_years_without_hits(spark):
    df = spark.createDataFrame(
        [("2010", 6.0), ("2010", 4.0), ("2011", 5.0)], "year string, first_resp double"
    )
    assert rows(indicators.exceedance_share(df)) == [("2010", 1, 2, 0.5)]


def test_histogram_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.25,), (0.26,), (0.75,), (None,)], "x double")
    out = distributions.histogram(df, "x")
    assert rows(out, "bin") == [(0, 1, 0.0), (1, 2, 0.5)]


def test_auto_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4, 5, 6, 9)], "x double")
    got = rows(distributions.auto_histogram(df, "x"), "bin")
    # Eight values: four classes of width 2 or so, the lowest takes its lower end.
    assert [g[1:] for g in got] == [
        (0.0, 2.0, 3), (2.0, 4.0, 2), (4.0, 6.0, 2), (6.0, 8.0, 0), (8.0, 10.0, 1),
    ]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert rows(distributions.auto_histogram(same, "x")) == [(1, 2.0, 3.0, 2)]


def test_six_numbers_of_missing_only(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0)], "k string, x double")
    out = distributions.six_number_summary(df, "x", ["k"])
    assert rows(out, "k") == [
        ("a", None, None, None, None, None, None, 1),
        ("b", 1.0, 1.25, 1.5, 1.5, 1.75, 2.0, 0),
    ]


def test_welch_with_p_value(spark):
    from firstdue.operators.significance import with_welch_p_value

    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, None]
    df = spark.createDataFrame(
        [("x", v) for v in a] + [("y", v) for v in b], "g string, v double"
    )
    test = distributions.welch_t_test(df, "v", "g", "x", "y")
    out = with_welch_p_value(test).collect()[0]
    assert (out["n1"], out["n2"]) == (5, 4)
    assert out["t"] == pytest.approx(-1.3587324, abs=1e-6)
    assert out["df"] == pytest.approx(4.7494145, abs=1e-6)
    assert 0.2 < out["p_value"] < 0.25
    assert out["conf_low"] < -2.0 < out["conf_high"]


# Sampling -----------------------------------------------------------------------


def test_sample_is_repeatable_and_counts(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = rows(sampling.seeded_sample(df, 50, ["k"], 124), "k")
    two = rows(sampling.seeded_sample(df.repartition(7), 50, ["k"], 124), "k")
    other = rows(sampling.seeded_sample(df, 50, ["k"], 125), "k")
    assert one == two and len(one) == 50 and one != other
    with pytest.raises(Exception, match="sample of 2000 rows"):
        sampling.seeded_sample(df, 2000, ["k"], 1).collect()
    with pytest.raises(Exception, match="sample of 1 rows"):
        sampling.seeded_sample(df.filter("k < 0"), 1, ["k"], 1).collect()
    assert sampling.seeded_sample(df, 2000, ["k"], 1, "keep").count() == 1000


def test_row_number(spark):
    keys = [f"{i * 37 % 1009} ST" for i in range(1009)] + [None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(6)
    got = {r["k"]: r["i"] for r in sampling.with_row_number(df, "k", "i", pieces=9).collect()}
    expected = {k: i for i, k in enumerate(sorted(k for k in keys if k), start=1)}
    assert got == {**expected, None: 1010}


# Drive times, calibration, scenarios ----------------------------------------------


def test_answers_and_pending(spark):
    body = (
        '{"rows":[{"elements":[{"duration":{"value":90},'
        '"duration_in_traffic":{"value":120}}]}]}'
    )
    df = spark.createDataFrame(
        [("a", body), ("b", '{"rows":[]}'), ("c", "no json"), ("d", None)], "k string, body string"
    )
    got = rows(drive_times.parse_answers(df), "k")
    assert got == [("a", 1.5, 2.0), ("b", None, None), ("c", None, None), ("d", None, None)]
    points = spark.createDataFrame(
        [("a", 2.0, 1.0), ("a", 1.0, 1.0)], "full_address string, lat double, lon double"
    )
    known = spark.createDataFrame([("a", "HQ")], "full_address string, station string")
    out = drive_times.pending_pairs(drive_times.destinations(points), known)
    assert out.count() == 6
    assert {r["destination"] for r in out.collect()} == {"1.0,1.0"}
    lowell = out.filter("station = 'Lowell'").collect()[0]
    assert lowell["origin"] == constants.STATIONS["Lowell"] and lowell["n"] == 2


def wide(spark, *times):
    names = list(constants.STATIONS)
    data = [(i, *t) for i, t in enumerate(times)]
    return spark.createDataFrame(
        data, "id int, " + ", ".join(f"from_{s} double" for s in names)
    )


def test_nearest_station(spark):
    # Columns: Lowell, HQ, FiveFifteen, JoyWashington, Highland, Teele, Union.
    df = wide(
        spark,
        (3.0, 2.0, 9.0, 9.0, 9.0, 9.0, 1.0),
        (3.0, 3.0, 9.0, 9.0, 9.0, 9.0, 3.00001),
        (None, 3.0, 9.0, 9.0, 9.0, 9.0, 3.0),
    )
    got = rows(df.select("id", scenarios.nearest_station(constants.SCENARIOS["Union_and_Lowell"])))
    assert got == [(0, "Union"), (1, "HQ"), (2, None)]


def test_scaling_and_scenarios(spark):
    df = wide(spark, (4.5, 5.0, 1.0, 2.0, 8.0, 8.0, 3.0), (None, 5.0, 1.0, 2.0, 8.0, 8.0, 3.0))
    fit = spark.createDataFrame([(1.5, -0.2)], "intercept double, slope double")
    out = calibration.with_calibrated_times(df, fit)
    out = scenarios.with_station_differences(scenarios.with_scenario_times(out))
    first, second = out.orderBy("id").collect()
    assert first["from_Lowell_scaled"] == pytest.approx(4.5001 * (1.5 - 0.9))
    assert first["from_HQ_scaled"] == pytest.approx(4.1)
    assert second["from_Lowell_scaled"] is None and second["JW_and_Lowell"] is None
    assert second["FiveFifteen_alone"] == pytest.approx(1.0001 * 1.3)
    assert first["HQ_v_Lowell"] == pytest.approx(4.1 - 4.5001 * 0.6)
    for name, stations in constants.SCENARIOS.items():
        assert first[name] == min(first[f"from_{s}_scaled"] for s in stations)


def test_line_fit_statistics(spark):
    x = np.array([1.0, 2.0, 3.0, 4.0, 6.0])
    y = np.array([2.1, 3.9, 6.2, 7.8, 12.5])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "predicted double, ratio double")
    got = calibration.fit_line(df).collect()[0]
    slope, intercept = np.polyfit(x, y, 1)
    rest = y - slope * x - intercept
    var = (rest**2).sum() / 3
    sxx = ((x - x.mean()) ** 2).sum()
    assert got["slope"] == pytest.approx(slope) and got["intercept"] == pytest.approx(intercept)
    assert got["se_slope"] == pytest.approx(np.sqrt(var / sxx))
    assert got["se_intercept"] == pytest.approx(np.sqrt(var * (1 / 5 + x.mean() ** 2 / sxx)))
    assert got["f_statistic"] == pytest.approx(got["t_slope"] ** 2)


def test_trim_is_strict(spark):
    df = spark.createDataFrame(
        [(-3.0, 1.0), (3.5, 1.0), (0.0, 0.5), (0.0, 2.0), (0.0, 1.0), (None, 1.0)],
        "diff double, ratio double",
    )
    assert rows(calibration.trim_outliers(df)) == [(0.0, 1.0)]


# Geocoding, columns, feeds ------------------------------------------------------


def test_geocode_and_unmatched(spark):
    records = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, full_address string")
    places = spark.createDataFrame([("a", 1.0, 2.0)], "full_address string, lon double, lat double")
    got = rows(geocoding.geocode(records, places).select("id", "n", "lon"), "id")
    assert got == [(1, 2, 1.0), (2, 2, 1.0), (3, 1, None)]
    assert rows(geocoding.unmatched_addresses(records, places)) == [("b", 1)]


def test_extend_gazetteer(spark):
    places = spark.createDataFrame(
        [("A", 3, -71.0, 42.0, "A, MA"), ("B", 1, -71.0994968, 42.0, "B, MA")],
        "location string, n_incidents long, lon double, lat double, full_address string",
    )
    answers = spark.createDataFrame(
        [("C, Somerville, MA", -71.2, 42.1), ("D, MA", None, None)],
        "full_address string, lon double, lat double",
    )
    got = rows(geocoding.extend_gazetteer(places, answers), "lon")
    full = "C, Somerville, Massachusetts"
    assert got == [(full, None, -71.2, 42.1, full), ("A", 3, -71.0, 42.0, "A, MA")]


def test_column_ranges_and_natural_join(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert columns.select_range(df, "b", "c", ["a"]).columns == ["a", "b", "c"]
    assert columns.drop_range(df, "b", "c").columns == ["a", "d"]
    left = spark.createDataFrame([(1, "x"), (None, "y")], "k int, l string")
    right = spark.createDataFrame([(1, "p"), (None, "q")], "k int, r string")
    assert columns.natural_join(left, right).count() == 1
    assert columns.natural_join(left, right, match_missing=True).count() == 2
    assert columns.append_rows(df, df.select("d", "c", "b", "a")).collect()[1] == (1, 2, 3, 4)


def test_address_means(spark):
    df = spark.createDataFrame(
        [(2, 1, "a", "E1", 4.0, 9.0, 9.0), (1, 1, "a", "E1", 8.0, 1.0, 2.0), (3, 1, "a", "E2", 0.0, 5.0, 5.0)],
        "incident_id int, addr_id int, full_address string, unit string, v double, lon double, lat double",
    )
    out = feeds.difference_map(df, "v", unit="E1").collect()[0]
    assert (out["n"], out["v"], out["lon"], out["lat"], out["faster"]) == (2, 6.0, 1.0, 2.0, "No")


# Spatial ------------------------------------------------------------------------


def test_grid_cells(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0), (1.0, 0.5, 3.0), (1.5, 2.0, 5.0)], "lon double, lat double, first_resp double"
    )
    out = spatial.grid_summary(df, "mean", width=1.0)
    got = rows(out.select("cell_x", "cell_y", "stat", "n", "lon", "lat"), "cell_x", "cell_y")
    # (0, 0) lies on the lowest edge and joins the first cell, with (1.0, 0.5).
    assert got == [(0, 0, 2.0, 2, 0.5, 0.5), (1, 1, 5.0, 1, 1.5, 1.5)]
    opened = spatial.grid_summary(df, "mean", width=1.0, closed_lowest=False)
    assert opened.agg(F.sum("n")).collect()[0][0] == 3 and opened.count() == 3


def test_density_against_brute_force(spark):
    draw = np.random.default_rng(3)
    x, y = draw.normal(0, 1, 400), draw.normal(5, 2, 400)
    x[:130], y[:130] = x[0], y[0]  # a third of all rows on one point
    df = spark.createDataFrame(
        [(float(a), float(b), "p" if i % 2 else "q") for i, (a, b) in enumerate(zip(x, y))],
        "lon double, lat double, year string",
    )

    def brute(a, b, size):
        def width(v):
            q1, q3 = np.quantile(v, [0.25, 0.75])
            return 1.06 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2

        gx, gy = np.linspace(x.min(), x.max(), size), np.linspace(y.min(), y.max(), size)
        kx = np.exp(-0.5 * ((gx[None] - a[:, None]) / width(a)) ** 2)
        ky = np.exp(-0.5 * ((gy[None] - b[:, None]) / width(b)) ** 2)
        return kx.T @ ky / (2 * np.pi * len(a) * width(a) * width(b))

    got = np.zeros((12, 12))
    for r in density.density_grid(df, 12).collect():
        got[r["ix"], r["iy"]] = r["density"]
    assert got == pytest.approx(brute(x, y, 12), rel=1e-9)
    odd = np.arange(400) % 2 == 1
    faceted = density.density_grid(df, 12, "year").filter("year = 'p'")
    got = np.zeros((12, 12))
    for r in faceted.collect():
        got[r["ix"], r["iy"]] = r["density"]
    assert got == pytest.approx(brute(x[odd], y[odd], 12), rel=1e-9)
    bands = [r["band"] for r in density.density_bands(density.density_grid(df, 12)).collect()]
    assert min(bands) == 1 and max(bands) == 16


def test_density_needs_spread(spark):
    # Most rows on one point: the quartiles are equal.
    df = spark.createDataFrame([(1.0, 2.0)] * 9 + [(3.0, 4.0), (5.0, 5.0)], "lon double, lat double")
    with pytest.raises(Exception, match="kernel width of axis"):
        density.density_grid(df, 5).collect()
    assert density.density_grid(df.limit(0), 5).count() == 0


def test_density_keeps_a_missing_facet_and_the_facets_type(spark):
    draw = np.random.default_rng(7)
    data = [(float(a), float(b), i % 2 or None) for i, (a, b) in enumerate(draw.normal(0, 1, (60, 2)))]
    df = spark.createDataFrame(data, "lon double, lat double, zone int")
    grid = density.density_grid(df, 6, "zone")
    assert dict(grid.dtypes)["zone"] == "int"
    assert {(r["zone"], r["n"]) for r in grid.groupBy("zone").agg(F.count("*").alias("n")).collect()} == {
        (None, 36), (1, 36)
    }


def test_grids_of_one_call_equal_grids_of_their_own(spark, tmp_path):
    draw = random.Random(8)
    data = [
        (draw.choice([1.0, draw.uniform(0, 9)]), draw.uniform(0, 9), draw.choice(["a", "b", None]),
         draw.choice([None, float("nan"), 3.0, draw.gauss(5, 2)]))
        for _ in range(3000)
    ] + [(None, 2.0, "a", 1.0)]
    spark.createDataFrame(data, "lon double, lat double, year string, first_resp double").write.parquet(
        str(tmp_path / "rows")
    )
    df = spark.read.parquet(str(tmp_path / "rows"))
    stats = {"median": "median", "p90": 0.9, "mean": "mean"}
    both = spatial.grid_statistics(df, stats, [None, "year"], width=2.0)
    assert both.columns == ["grid", "year", "cell_x", "cell_y", "median", "p90", "mean", "n", "lon", "lat"]
    final = final_plan(both)
    assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 1
    for grid, facet in (("all", None), ("year", "year")):
        got = both.filter(F.col("grid") == grid)
        for name, stat in stats.items():
            own = spatial.grid_summary(df, stat, facet=facet, width=2.0)
            keys = [facet] * bool(facet) + ["cell_x", "cell_y"]
            wanted = own.select(*keys, F.round("stat", 9), "n", "lon", "lat")
            assert sorted(map(repr, got.select(*keys, F.round(name, 9), "n", "lon", "lat").collect())) == (
                sorted(map(repr, wanted.withColumnRenamed("round(stat, 9)", f"round({name}, 9)").collect()))
            )
    by_year = {}
    for lon, lat, year, x in data:
        cell = (None if lon is None else max(-(-lon // 2) - 1, 0), max(-(-lat // 2) - 1, 0), year)
        by_year.setdefault(cell, []).append(x)
    for r in both.filter("grid = 'year'").collect():
        x = [v for v in by_year[r["cell_x"], r["cell_y"], r["year"]] if v is not None and v == v]
        assert r["n"] == len(by_year[r["cell_x"], r["cell_y"], r["year"]])
        if x:
            assert (r["median"], r["p90"], r["mean"]) == pytest.approx(
                (np.quantile(x, 0.5), np.quantile(x, 0.9), sum(x) / len(x)), rel=1e-9
            )


def test_dot_points_with_one_hot_coordinate(spark):
    draw = random.Random(9)
    data = [(1.0, 2.0, draw.gauss(5, 2)) if i % 3 else (i % 500 / 7, 3.0, draw.gauss(5, 2)) for i in range(9000)]
    df = spark.createDataFrame(data, "lon double, lat double, first_resp double")
    groups = {}
    for lon, lat, x in data:
        groups.setdefault((lon, lat), []).append(x)
    got = {(r["lon"], r["lat"]): (r["median"], r["n"]) for r in spatial.dot_points(df).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k] == (pytest.approx(float(np.quantile(x, 0.5)), rel=1e-12), len(x))
    hot = df.filter("lon = 1.0 and lat = 2.0").withColumn("b", quantiles._bucket(F.col("first_resp")))
    assert hot.repartition(16, "lon", "lat", "b").select(F.spark_partition_id()).distinct().count() == 16


def test_values_on_cell_edges(spark):
    # 0.002 * k is not exact in binary; each edge belongs to the cell below it.
    edges = [-71.1 + 0.002 * k for k in range(1, 60)]
    df = spark.createDataFrame([(e, k) for k, e in enumerate(edges, 1)], "x double, k int")
    got = df.select(spatial.cell_number(F.col("x"), 0.002).alias("c"), "k").collect()
    assert all(r["c"] == -35550 + r["k"] - 1 for r in got)


def test_breaks_on_round_numbers(spark):
    # Width 0.1 or 0.2: the lowest value lies on a break and opens no class of its own.
    for low, step in ((0.3, 0.1), (0.6, 0.1), (0.7, 0.1), (1.2, 0.1)):
        values = [low + step * k for k in range(5)]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = rows(distributions.auto_histogram(df, "x"), "bin")
        assert got[0][3] > 0 and got[-1][3] > 0, (low, got)
        assert sum(g[3] for g in got) == 5
        assert got[0][1] == pytest.approx(low) and got[-1][2] == pytest.approx(values[-1])


# Edges as they are written, and the bin below each: (width, {edge: bin}).
EDGES = [
    (0.1, {0.05: 0, 0.15: 1, 0.25: 2, 0.35: 3, 0.45: 4, 0.55: 5, 0.65: 6, 0.75: 7, 1.15: 11, 4.35: 43, 7.05: 70}),
    (0.2, {0.1: 0, 0.3: 1, 0.5: 2, 0.7: 3, 0.9: 4, 1.1: 5, 1.3: 6, 1.5: 7, 1.7: 8, 4.7: 23, 6.9: 34}),
    (0.3, {0.15: 0, 0.45: 1, 0.75: 2, 1.05: 3, 1.35: 4, 1.65: 5, 1.95: 6, 2.25: 7, 4.35: 14, 6.75: 22}),
    (0.5, {0.25: 0, 0.75: 1, 1.25: 2, 7.25: 14}),
]


@pytest.mark.parametrize("width,edges", EDGES)
def test_values_on_bin_edges(spark, width, edges):
    df = spark.createDataFrame([(x, b) for x, b in edges.items()], "x double, b long")
    got = df.select("x", "b", distributions.centred_bin(F.col("x"), width).alias("bin")).collect()
    assert [r for r in got if r["b"] != r["bin"]] == []
    past = df.select(distributions.centred_bin(F.col("x") + 1e-6, width).alias("bin"), "b").collect()
    assert all(r["bin"] == r["b"] + 1 for r in past)


def test_the_lowest_edge_opens_no_bin(spark):
    df = spark.createDataFrame([(0.15, "a"), (0.2, "a"), (0.25, "b"), (None, "b")], "x double, k string")
    got = rows(distributions.histogram(df, "x", "k", 0.1, closed_lowest=True), "k")
    assert got == [("a", 2, 2, 0.2), ("b", 2, 1, 0.2)]
    opened = distributions.histogram(df, "x", None, 0.1)
    assert rows(opened.select("bin", "n"), "bin") == [(1, 1), (2, 2)]
    assert distributions.histogram(df.limit(0), "x", closed_lowest=True).count() == 0


def test_answer_faults(spark):
    good = '{"rows":[{"elements":[{"duration":{"value":60}}]}]}'
    bodies = [
        (None, "missing"), (" ", "missing"), ("{bad", "json"), ("[]", "json"), ("3", "json"), ("{}", "rows"),
        ('{"rows":[]}', "rows"), ('{"rows":[{"elements":[{"status":"NOT_FOUND"}]}]}', "duration"),
        (good.replace("60", '"x"'), "json"), (good, None), (good.replace("duration", "other"), "duration"),
    ]
    df = spark.createDataFrame([(i, b, f"f{i}") for i, (b, _) in enumerate(bodies)], "k int, body string, file string")
    faults = drive_times.answer_faults(df)
    assert faults.columns == ["k", "file", "reason", "body"]
    got = {r["k"]: (r["reason"], r["file"], r["body"]) for r in faults.collect()}
    assert got == {i: (why, f"f{i}", b) for i, (b, why) in enumerate(bodies) if why}
    times = {r["k"]: r["minutes"] for r in drive_times.parse_answers(df).collect()}
    assert all((times[i] is None) == (why is not None) for i, (_, why) in enumerate(bodies))


def test_numbers_stay_over_loads(spark, tmp_path):
    path = str(tmp_path / "numbers")

    def load(number, *keys):
        df = spark.createDataFrame([(k,) for k in keys], "address string")
        out = sampling.extend_numbers(df, path, "address", "number", number)
        return {r["address"]: (r["number"], r["load"]) for r in out.collect()}

    first = load(1, "m", "c", "m", None)
    assert first == {"c": (1, 1), "m": (2, 1)}
    second = load(2, "z", "a", "m", "b")
    assert second == {**first, "a": (3, 2), "b": (4, 2), "z": (5, 2)}
    assert load(2, "q", "r") == second  # a repeated load adds nothing
    assert load(None) == second and load(None, "y") == {**second, "y": (6, 4)}


def test_density_sums_to_one(spark):
    corners = [(-9.0, -9.0), (9.0, 9.0)]
    draw = np.random.default_rng(4)
    cloud = [tuple(map(float, p)) for p in draw.normal(0, 1, (500, 2))]
    df = spark.createDataFrame(cloud + corners, "lon double, lat double")
    total = density.density_grid(df, 80).agg(F.sum("density")).collect()[0][0]
    assert total * (18 / 79) ** 2 == pytest.approx(1, abs=0.02)
