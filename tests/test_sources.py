from pathlib import Path

import pytest

from pluvigrid import session

from pluvigrid.operators.cleaning import clean_daily
from pluvigrid.plans.process import output_row_counts, process_readings
from pluvigrid.schemas import PROCESSED_SCHEMAS
from pluvigrid.sources import processed, readings


def write(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture
def raw_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write(folder, "2016.csv", "Date,State,District,Avg_rainfall",
          "2016-06-01,Telangana,WARANGAL ,4", "2016-06-02,Telangana,Warangal,", '2016-06-03,Telangana,"Warangal",8.5')
    write(folder, "2017.csv", "Date,District,State,Avg_rainfall,Extra",
          "2017-06-01,Warangal,Telangana,NA,x", '2017-06-02,Warangal,Telangana,2,"a,""b"""')
    write(folder, "notes.txt", "not a CSV")
    return folder


def test_columns_are_matched_by_name(spark, raw_folder):
    df = readings.read_daily_csv(spark, str(raw_folder))
    assert df.columns == ["Date", "State", "District", "Avg_rainfall", "Extra", "source_file", "file_position"]
    rows = df.orderBy("Date").collect()
    assert {r["State"] for r in rows} == {"Telangana"}
    assert [r["source_file"] for r in rows] == ["2016.csv"] * 3 + ["2017.csv"] * 2
    assert [r["Extra"] for r in rows] == [None, None, None, "x", 'a,"b"']


def test_file_row_counts(spark, raw_folder):
    counts = readings.file_row_counts(readings.read_daily_csv(spark, str(raw_folder))).collect()
    assert {r["source_file"]: r["n_rows"] for r in counts} == {"2016.csv": 3, "2017.csv": 2}


def test_union_widens_numbers(spark):
    ints = spark.createDataFrame([(1, "a")], "x INT, y STRING")
    doubles = spark.createDataFrame([(2.5, True)], "x DOUBLE, z BOOLEAN")
    both = readings.union_by_name(ints, doubles)
    assert sorted(map(tuple, both.collect()), key=str) == [(1.0, "a", None), (2.5, None, True)]


def test_missing_inputs(spark, tmp_path):
    for folder in (tmp_path, tmp_path / "absent"):
        with pytest.raises(FileNotFoundError):
            readings.read_daily_csv(spark, str(folder))


def test_files_spark_would_skip_are_an_error(spark, raw_folder):
    write(raw_folder, "_u.csv", "Date,State,District,Avg_rainfall", "2018-06-01,S,D,1")
    with pytest.raises(ValueError, match="_u.csv"):
        readings.read_daily_csv(spark, str(raw_folder))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_process_readings(spark, raw_folder, tmp_path, fmt):
    out = str(tmp_path / "out")
    summary = process_readings(spark, str(raw_folder), out, fmt)
    counts = summary.rows
    assert counts == {"daily": 5, "monthly": 2, "seasonal": 2, "probability": 1}
    assert {tuple(r) for r in output_row_counts(spark, counts).collect()} == set(counts.items())
    for name, schema in PROCESSED_SCHEMAS.items():
        df = processed.read_table(spark, out, name, fmt)
        types = [f"{f.name} {f.dataType.simpleString().upper()}" for f in df.schema if f.name != "Extra"]
        assert types == schema.split(", ")
    daily = processed.read_table(spark, out, "daily", fmt).orderBy("date").collect()
    # 2017 starts with a gap between 8.5 and 2; rows count, not days.
    assert [r["rainfall_mm"] for r in daily] == [4.0, 6.25, 8.5, 5.25, 2.0]
    monthly = processed.read_monthly(spark, out, fmt).orderBy("year").collect()
    assert [r["total_rainfall_mm"] for r in monthly] == [18.75, 7.25]
    assert [r["rainy_days"] for r in monthly] == [3, 1]
    assert monthly[0]["lpa_mm"] == 13.0 and monthly[0]["departure_pct"] == 44.23
    assert (summary.rejected, summary.missing_before, summary.missing_after) == (0, 2, 0)
    assert [summary.coverage[k] for k in ("n_districts", "n_states", "n_years")] == [1, 1, 2]
    tables = processed.load_processed(spark, out, fmt)
    assert tables["probability"].first()["prob_above_normal_pct"] == 50.0
    assert spark.table("seasonal").count() == 2


def test_quarantine_keeps_bad_rows(spark, raw_folder, tmp_path):
    write(raw_folder, "2018.csv", "Date,State,District,Avg_rainfall", "01-06-2018,Telangana,Warangal,4")
    bad = str(tmp_path / "bad")
    with pytest.raises(Exception, match="not a YYYY-MM-DD date"):
        process_readings(spark, str(raw_folder), str(tmp_path / "strict"))
    summary = process_readings(spark, str(raw_folder), str(tmp_path / "out"), quarantine_folder=bad)
    assert (summary.rows["daily"], summary.rejected) == (5, 1)
    assert [r["reject_reason"] for r in spark.read.parquet(bad).collect()] == ["date"]


@pytest.mark.parametrize("line,reason", [
    ("2016-06-05,Telangana,Warangal,2,77", "fields"),
    ("2016-06-05,Telangana,Warangal,3d", "rainfall_mm"),
    ("2016-06-05,Telangana,Warangal,2f", "rainfall_mm"),
    ("2016-06-05,Telangana,Warangal,0x1p3", "rainfall_mm"),
    ("+12016-06-01,Telangana,Warangal,1", "date"),
])
def test_strange_lines_stop_the_job_or_are_set_aside(spark, raw_folder, tmp_path, line, reason):
    write(raw_folder, "2018.csv", "Date,State,District,Avg_rainfall", line, "2016-06-06,Telangana,Warangal")
    with pytest.raises(Exception, match="not a|more fields than the header in 2018.csv"):
        process_readings(spark, str(raw_folder), str(tmp_path / "strict"))
    bad = str(tmp_path / "bad")
    summary = process_readings(spark, str(raw_folder), str(tmp_path / "out"), quarantine_folder=bad)
    # The short line is padded and kept.
    assert (summary.rows["daily"], summary.rejected) == (6, 1)
    assert [r["reject_reason"] for r in spark.read.parquet(bad).collect()] == [reason]


@pytest.mark.parametrize("quarantine", [False, True])
def test_line_breaks_reach_the_job(spark, tmp_path, quarantine):
    write(tmp_path, "a.csv", "Date,State,District,Avg_rainfall,Note", '2016-06-01,S,D,1,"two', 'lines"')
    bad = str(tmp_path / "bad") if quarantine else None
    summary = process_readings(spark, str(tmp_path), str(tmp_path / "out"), quarantine_folder=bad, multi_line=True)
    assert summary.rows["daily"] == 1
    assert processed.read_table(spark, str(tmp_path / "out"), "daily").first()["Note"] == "two\nlines"


def test_nothing_is_left_in_the_shared_folder(spark, raw_folder, tmp_path):
    before = set(Path(session._application_folder(spark)).glob("*"))
    process_readings(spark, str(raw_folder), str(tmp_path / "out"), quarantine_folder=str(tmp_path / "bad"))
    assert set(Path(session._application_folder(spark)).glob("*")) == before


def test_shared_folder_is_demanded_on_a_cluster():
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_path(Session(), "x")


def test_missing_tables_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        processed.read_seasonal(spark, str(tmp_path))
    path = f"{tmp_path}/03_seasonal_with_departure"
    spark.createDataFrame([("D", 2016)], "district_name STRING, year INT").write.parquet(path)
    with pytest.raises(ValueError, match="season"):
        processed.read_seasonal(spark, str(tmp_path))


def test_position_in_file_orders_same_day_rows(spark, tmp_path):
    lines = [f"2016-06-01,S,D,{v}" for v in ("1", "", "", "7", "")]
    write(tmp_path, "a.csv", "Date,State,District,Avg_rainfall", *lines)
    clean = clean_daily(readings.read_daily_csv(spark, str(tmp_path)))
    assert sorted(r["rainfall_mm"] for r in clean.collect()) == [1, 3, 5, 7, 7]


def test_blank_first_line_and_tokens_in_other_columns(spark, tmp_path):
    write(tmp_path, "a.csv", "", "Date,State,District,Avg_rainfall,Note", "2016-06-01,S,D,1,n/a")
    row = readings.read_daily_csv(spark, str(tmp_path)).first()
    assert (row["District"], row["Note"]) == ("D", None)


def test_line_breaks_in_quotes(spark, tmp_path):
    write(tmp_path, "a.csv", "Date,State,District,Avg_rainfall,Note", '2016-06-01,S,D,1,"two', 'lines"')
    rows = readings.read_daily_csv(spark, str(tmp_path), multi_line=True).collect()
    assert [r["Note"] for r in rows] == ["two\nlines"]


def test_empty_file(spark, tmp_path):
    write(tmp_path, "a.csv", "")
    with pytest.raises(ValueError, match="without a header"):
        readings.read_daily_csv(spark, str(tmp_path))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_headers_without_rows(spark, tmp_path, fmt):
    write(tmp_path, "a.csv", "Date,State,District,Avg_rainfall")
    summary = process_readings(spark, str(tmp_path), str(tmp_path / "out"), fmt)
    assert set(summary.rows.values()) == {0}
