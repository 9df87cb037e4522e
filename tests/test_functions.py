"""Expressions on hand-made rows: null rules, edges, text, dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from firstdue.functions import labels, nulls, student, text
from firstdue.functions.dates import parse_received, wall_clock, with_date_parts
from firstdue.operators.geocoding import normalize_address


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, None)], "a double, b double")
    got = values(
        df,
        nulls.row_min(["a", "b"]),
        nulls.if_else(F.col("a") > 1, "y", "n"),
        nulls.is_in("a", [1.0]),
        nulls.not_in("a", [1.0]),
        nulls.paste("a", "b"),
    )
    assert got == [
        (1.0, "n", True, False, "1.0 2.0"),
        (None, None, False, True, "NA 2.0"),
        (None, "y", False, True, "3.0 NA"),
    ]


def test_na_policy_and_percent_change(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, x double")
    out = df.groupBy("k").agg(
        nulls.na_policy(F.avg("x"), "x").alias("skip"),
        nulls.na_policy(F.avg("x"), "x", "propagate").alias("all"),
    )
    assert sorted(values(out, "*")) == [("a", 1.0, None), ("b", 2.0, 2.0)]
    change = spark.createDataFrame([(2.0, 3.0), (0.0, 1.0)], "p double, q double")
    assert values(change, nulls.percent_change("p", "q")) == [(0.5,), (None,)]
    with pytest.raises(ValueError):
        nulls.na_policy(F.avg("x"), "x", "other")


def test_band_edges(spark):
    df = spark.createDataFrame(
        [(x,) for x in (-1.0, 0.0, 0.1, 2.0, 2.1, 4.0, 5.0, 5.1, None)], "x double"
    )
    got = values(df, labels.minutes_band(F.col("x")), labels.under_limit(F.col("x")))
    assert got == [
        ("5 +", "Yes"), ("5 +", "Yes"), ("0-2", "Yes"), ("0-2", "Yes"), ("2-4", "Yes"),
        ("2-4", "Yes"), ("4-5", "Yes"), ("5 +", "No"), (None, None),
    ]
    assert values(df, labels.censor(F.col("x"), 0, 2))[:4] == [(None,), (0.0,), (0.1,), (2.0,)]


def test_bad_geocode(spark):
    rows = [
        (None, 42.4, -71.1), ("1 BIKE PATH, Somerville, Massachusetts", 42.4, -71.1),
        ("ok", 42.36, -71.1), ("ok", 42.4, -71.1), ("ok", None, -71.1), ("ok", 42.4, None),
        ("ok", 42.4, 71.2),
    ]
    df = spark.createDataFrame(rows, "a string, lat double, lon double")
    got = values(df, labels.bad_geocode(F.col("a"), F.col("lat"), F.col("lon")))
    assert [g[0] for g in got] == [1, 1, 1, 0, None, None, 0]


def test_fallback_and_ambiguous(spark):
    df = spark.createDataFrame([(-71.0994968,), (-71.1,), (None,)], "x double")
    keep = labels.not_fallback_point(F.col("x"), [-71.0994968])
    assert values(df.filter(keep), "x") == [(-71.1,)]
    df = spark.createDataFrame(
        [("0", "A"), ("1", "BROADWAY, Somerville, MA"), ("1", "A"), (None, "A")],
        "n string, a string",
    )
    got = values(df, labels.ambiguous_address(F.col("n"), F.col("a")))
    assert got == [(1,), (1,), (0,), (None,)]


def test_trim_and_strip(spark):
    df = spark.createDataFrame([("\t a b \n",), ("0 100 MAIN",), ("100 MAIN",)], "t string")
    assert values(df, text.trim_ws("t"))[0] == ("a b",)
    every = [v[0] for v in values(df, text.strip_lead(F.col("t"), "0 "))]
    assert every[1:] == ["10MAIN", "100 MAIN"]
    lead = [v[0] for v in values(df, text.strip_lead(F.col("t"), "0 ", "prefix"))]
    assert lead[1:] == ["100 MAIN", "100 MAIN"]


def test_normalize_address(spark):
    rows = [
        ("12", "MAIN AV", ""), ("", "ELM AV", "OAK ST"), ("", "", "OAK ST"), ("", "", ""),
        ("0", "MAIN R ST", ""), ("5", "X B Y", ""), ("7 A", "ELM ST", ""), (None, "ELM ST", "X"),
        ("", None, "OAK ST"), ("", "ELM ST", ""), ("9", "OPPOSITE PARK", ""), ("0", "100 MAIN", ""),
    ]
    df = spark.createDataFrame(rows, "st_num string, st_name1 string, st_name2 string")
    end = ", Somerville, Massachusetts"
    got = [v[0] for v in values(normalize_address(df), "full_address")]
    assert got == [
        "12 MAIN AVE" + end, "ELM AVE and OAK ST" + end, "OAK ST" + end, "MAIN ST" + end,
        "5 X Y" + end, "7 ELM ST" + end, "and OAK ST" + end, "ELM ST" + end, "9 PARK" + end,
        "10MAIN" + end,
    ]
    second = [v[0] for v in values(normalize_address(df, variant="v2"), "full_address")]
    assert second[:2] == ["12 MAIN AVE, Somerville, MA", "ELM AVE & OAK ST, Somerville, MA"]


def test_parse_received(spark):
    texts = ["02/03/2015 14:05", "2/3/2015 4:05", "junk", None, "12/31/15 23:59", "1/2/69 0:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    local = F.date_format(wall_clock(parse_received("t"), "-05:00"), "yyyy-MM-dd HH:mm")
    assert [v[0] for v in values(df, local)] == [
        "2015-02-03 14:05", "2015-02-03 04:05", None, None, "2015-12-31 23:59",
        "1969-01-02 00:00",
    ]


def test_day_is_utc_but_month_is_local(spark):
    df = spark.createDataFrame([("12/31/2014 20:00",)], "t string")
    df = with_date_parts(df.withColumn("ts", parse_received("t")), "ts")
    got = values(df, "date_short", "year_month", "month", "year")
    assert got == [(dt.date(2015, 1, 1), "2014-12", "12", "2014")]
    same = with_date_parts(df.select("ts"), "ts", day_zone="-05:00")
    assert values(same, "date_short") == [(dt.date(2014, 12, 31),)]


def test_student_known_values():
    assert student.two_sided_p(2.228, 10) == pytest.approx(0.05, abs=2e-5)
    assert student.two_sided_p(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    assert student.two_sided_p(1.96, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert student.two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert student.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert student.t_quantile(0.995, 30) == pytest.approx(2.7499957, abs=1e-6)
