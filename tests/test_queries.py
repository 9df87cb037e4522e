"""Every registered query against its SQL, and properties of the results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from firstdue.plans.checks import ORACLE, QUERIES
from firstdue.sources import adapters
from oracle import compare, connect



@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    assert compare(df, con, entry.oracle_sql()[name]) is None


def test_the_stored_report_reads_one_year(spark, folder):
    plan = entry.queries()["stored_report"](spark, folder)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_responses_keep_the_rows_of_the_activity(spark, folder):
    fd = adapters.responses(spark, folder)
    assert fd.count() == adapters.activity(spark, folder).count()
    first = entry.queries()["first_responder"](spark, folder)
    assert first.count() == first.select("incident_id").distinct().count()


def test_grid_counts_sum_to_rows(spark, folder):
    grid = entry.queries()["grid_mean"](spark, folder).agg(F.sum("n")).collect()[0][0]
    rows = adapters.responses(spark, folder).filter(
        (F.col("is_first") == 1)
        & F.col("nature").isin(adapters.NATURES)
        & (F.col("lat") >= 42.37)
        & F.col("lon").isNotNull()
    )
    assert grid == rows.count()


@pytest.mark.parametrize("name", ["master_table", "calibrated_time", "grid_median", "address_id"])
def test_result_does_not_depend_on_partitions(spark, folder, name):
    query = entry.queries()[name]
    one = sorted(map(str, query(spark, folder).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, query(spark, folder).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
