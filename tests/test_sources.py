"""CSV rules, stored drive times, working folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from firstdue.session import work_dir
from firstdue.sources import files, saves, tables


def test_csv_missing_and_blank(spark, tmp_path):
    path = tmp_path / "arrivals.csv"
    path.write_text(
        'Incnum,Unit,Resp.Time,Other\n1,"E3",2.5,x\n2,,NA,x\n3,"",bad,x\n4,NA,4,x\n'
        '5,"a ""q"", b",5,x\n6, E1 ,1e1,x\n'
    )
    df = files.read_csv(spark, str(path), tables.ARRIVALS, tables.ARRIVALS_NAMES)
    assert df.columns == ["incident_id", "unit", "resp_time"]
    assert [tuple(r) for r in df.collect()] == [
        ("1", "E3", 2.5), ("2", "", None), ("3", "", None), ("4", None, 4.0),
        ("5", 'a "q", b', 5.0), ("6", " E1 ", 10.0),
    ]


def test_csv_round_trip(spark, tmp_path):
    data = [("1", None, 1.5), ("2", "", None), ("3", 'a,"x" \\ ', 1e-9), ("4", " x ", 1e10)]
    df = spark.createDataFrame(data, "incident_id string, unit string, resp_time double")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(data)


def test_saves_add_up_and_the_latest_wins(spark, tmp_path):
    path = str(tmp_path / "times")
    kind = "full_address string, station string, minutes double"

    def save(*data):
        files.save_drive_times(spark.createDataFrame(data, kind), path)

    save(("a", "HQ", 1.0), ("b", "HQ", 2.0), ("a", "Union", 3.0))
    save(("c", "HQ", 4.0))  # a part of a station: the stored rows stay
    save(("a", "HQ", 9.0), ("d", "HQ", 5.0), ("d", "HQ", 6.0))
    got = files.read_drive_times(spark, path).select("full_address", "station", "minutes")
    assert sorted(map(tuple, got.collect())) == [
        ("a", "HQ", 9.0), ("a", "Union", 3.0), ("b", "HQ", 2.0), ("c", "HQ", 4.0), ("d", "HQ", 6.0),
    ]


TIMES = "full_address string, station string, minutes double"


def latest(spark, path):
    got = files.read_drive_times(spark, path).select("full_address", "station", "minutes")
    return sorted(map(tuple, got.collect()))


def test_a_repeated_save_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "times")
    save = lambda number, *data: files.save_drive_times(spark.createDataFrame(data, TIMES), path, number)
    assert save(None, ("a", "HQ", 1.0)) == 1 and save(None, ("b", "HQ", 2.0)) == 2
    before = sorted(p.name for p in (tmp_path / "times").rglob("*"))
    assert save(2, ("b", "HQ", 7.0), ("c", "HQ", 8.0)) == 2
    assert sorted(p.name for p in (tmp_path / "times").rglob("*")) == before
    assert latest(spark, path) == [("a", "HQ", 1.0), ("b", "HQ", 2.0)]
    # Numbers need not come in order: the higher one wins.
    assert save(9, ("a", "HQ", 5.0)) == 9 and save(4, ("a", "HQ", 4.0), (None, "HQ", 3.0)) == 4
    assert saves.saved_numbers(spark, path) == [1, 2, 4, 9]
    assert files.read_drive_times(spark, path).filter("full_address is null").count() == 1
    with pytest.raises(ValueError, match="nothing is saved"):
        files.read_drive_times(spark, str(tmp_path / "none"))


def test_compaction_keeps_the_latest_and_what_comes_after(spark, tmp_path):
    path = str(tmp_path / "times")
    save = lambda *data: files.save_drive_times(spark.createDataFrame(data, TIMES), path)
    save(("a", "HQ", 1.0), ("b", "HQ", 2.0), ("a", "Union", 3.0), (None, "HQ", 0.5))
    save(("a", "HQ", 9.0), ("c", "HQ", 4.0))
    wanted = files.read_drive_times(spark, path).collect()
    assert files.compact_drive_times(spark, path) == 2
    key = lambda rows: sorted(map(repr, (r.asDict() for r in rows)))
    assert key(files.read_drive_times(spark, path).collect()) == key(wanted)
    # The compacted table is read as it is.
    plan = files.read_drive_times(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert files.compact_drive_times(spark, path) == 2 and save(("a", "HQ", 0.0), (None, "HQ", 7.0)) == 3
    got = {(r["full_address"], r["station"]): r["minutes"] for r in files.read_drive_times(spark, path).collect()}
    assert got == {("a", "HQ"): 0.0, ("b", "HQ"): 2.0, ("a", "Union"): 3.0, ("c", "HQ"): 4.0, (None, "HQ"): 7.0}
    # A save that the compaction has taken in adds nothing, even after its folder is gone.
    saves.drop_replaced(spark, path)
    assert saves.saved_numbers(spark, path) == [2, 3]
    files.save_drive_times(spark.createDataFrame([("z", "HQ", 1.0)], TIMES), path, 1)
    assert files.read_drive_times(spark, path).count() == 5
    assert files.compact_drive_times(spark, path) == 3
    saves.drop_replaced(spark, path)
    assert files.read_drive_times(spark, path).count() == 5


def test_interrupted_jobs_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "times")
    save = lambda number, *data: files.save_drive_times(spark.createDataFrame(data, TIMES), path, number)
    save(1, ("a", "HQ", 1.0))
    save(2, ("b", "HQ", 2.0))
    # As a save and a compaction leave it that end before their last step.
    unmark = lambda kind, n: (tmp_path / f"times/save_kind={kind}/save_number={n}/_SUCCESS").unlink()
    unmark("save", 2)
    assert latest(spark, path) == [("a", "HQ", 1.0)]
    save(2, ("b", "HQ", 3.0))
    files.compact_drive_times(spark, path)
    unmark("whole", 2)
    assert latest(spark, path) == [("a", "HQ", 1.0), ("b", "HQ", 3.0)]
    saves.drop_replaced(spark, path)  # nothing is replaced yet
    assert latest(spark, path) == [("a", "HQ", 1.0), ("b", "HQ", 3.0)]
    assert files.compact_drive_times(spark, path) == 2
    assert latest(spark, path) == [("a", "HQ", 1.0), ("b", "HQ", 3.0)]


def test_bad_csv_rows_go_to_a_second_table(spark, tmp_path):
    path = tmp_path / "arrivals.csv"
    path.write_text(
        'Incnum,Unit,Resp.Time,n\n1,"E3",2.5,3\n2,,NA,\n3,"",bad,x\n4,NA,4,5\n5,short\n6,E1,7,1,more\n'
        '7,"a,""b""", ,NA\n\n'
    )
    schema = StructType([*tables.ARRIVALS.fields, StructField("n", IntegerType())])
    good, bad = files.read_csv_checked(spark, str(path), schema, tables.ARRIVALS_NAMES)
    assert [tuple(r) for r in good.collect()] == [
        ("1", "E3", 2.5, 3), ("2", "", None, None), ("4", None, 4.0, 5), ("7", 'a,"b"', None, None),
    ]
    rows = sorted((r["reason"], r["column"] or "", r["value"] or "", r["row"]) for r in bad.collect())
    spoilt = '{"Incnum":"3","Resp.Time":"bad","n":"x"}'
    assert rows == [
        ("cells", "", "", "5,short"), ("cells", "", "", "6,E1,7,1,more"),
        ("type", "Resp.Time", "bad", spoilt), ("type", "n", "x", spoilt),
    ]
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"arrivals.csv"}
    # All rows, as before, with their file.
    every = files.read_csv(spark, str(path), schema, tables.ARRIVALS_NAMES, file="source")
    assert every.count() == 7 and every.filter("source like '%arrivals.csv'").count() == 7
    with pytest.raises(ValueError, match="no column Nature"):
        files.read_csv_checked(spark, str(path), StructType([StructField("Nature", StringType())]))


def test_csv_columns_are_found_by_name(spark, tmp_path):
    # Row names first, the key after, further columns between.
    path = tmp_path / "locations.csv"
    path.write_text(
        '"","IncNum","n","lat","Full.Address","lon"\n"1","A-7",3,42.4,"1 MAIN ST",-71.1\n'
        '"2","A-8",NA,NA,"",-71.2\n'
    )
    df = files.read_csv(spark, str(path), tables.LOCATIONS, tables.LOCATIONS_NAMES)
    assert [tuple(r) for r in df.collect()] == [
        ("A-7", "1 MAIN ST", -71.1, 42.4), ("A-8", "", -71.2, None),
    ]
    with pytest.raises(ValueError, match="no column Incnum, Unit, Resp.Time"):
        files.read_csv(spark, str(path), tables.ARRIVALS)


def test_saved_responses_prune_by_year(spark, tmp_path):
    path = str(tmp_path / "responses")
    df = spark.createDataFrame([(1, "2015"), (2, "2014")], "incident_id int, year string")
    files.save_responses(df, path)
    plan = spark.read.parquet(path).filter("year = '2015'")
    assert plan.count() == 1
    assert "PartitionFilters: [isnotnull(year" in plan._jdf.queryExecution().toString()


class FakeSession:
    """A session as far as the working folder looks at it."""

    def __init__(self, master, folder=None):
        settings = {"spark.checkpoint.dir": folder}
        self.conf = SimpleNamespace(get=lambda key, default: settings.get(key) or default)
        self.sparkContext = SimpleNamespace(master=master)


def test_work_dir_follows_the_session(spark):
    assert work_dir(spark, "x") != work_dir(spark, "x")
    assert work_dir(FakeSession("yarn", "/shared/work/"), "x").startswith("/shared/work/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(FakeSession("yarn"), "x")


@pytest.mark.parametrize("schema", [tables.ACTIVITY, tables.LOCATIONS, tables.GAZETTEER])
def test_declared_tables_rename_every_dotted_column(schema):
    names = {**tables.ACTIVITY_NAMES, **tables.LOCATIONS_NAMES, **tables.GAZETTEER_NAMES}
    assert all("." not in names.get(f.name, f.name) for f in schema.fields)
