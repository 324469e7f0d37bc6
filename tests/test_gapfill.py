import datetime
import random

import pytest
from pyspark.sql import functions as F

from pluvigrid.operators.cleaning import clean_daily, split_rejects, standardise
from pluvigrid.operators import gapfill
from pluvigrid.operators.gapfill import fill_gaps
from pluvigrid.operators.ordering import runs_for

CHUNKS = ["day", "month", "year", "range"]
START = datetime.date(2020, 1, 30)


def day(n):
    return START + datetime.timedelta(days=n)


def series(spark, readings, district="A", step=1):
    rows = [(day(i * step), district, v) for i, v in enumerate(readings)]
    return spark.createDataFrame(rows, "date DATE, district_name STRING, rainfall_mm DOUBLE")


def filled(df, **options):
    if options.get("chunk") == "range":
        options["runs"] = 4
    return [r["rainfall_mm"] for r in fill_gaps(df, **options).orderBy("district_name", "date").collect()]


def by_hand(readings, leading=True):
    """Row-position interpolation on a Python list."""
    known = [i for i, v in enumerate(readings) if v is not None]
    out = []
    for i, v in enumerate(readings):
        before = [k for k in known if k < i]
        after = [k for k in known if k > i]
        if v is None and before and after:
            p, n = before[-1], after[0]
            v = (readings[n] - readings[p]) / (n - p) * (i - p) + readings[p]
        elif v is None and before:
            v = readings[before[-1]]
        elif v is None and after and leading:
            v = readings[after[0]]
        out.append(v)
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
def test_toy_series(spark, chunk):
    df = series(spark, [None, 1.0, None, None, 4.0, None, None])
    assert filled(df, chunk=chunk) == [1, 1, 2, 3, 4, 4, 4]
    assert filled(df, chunk=chunk, edges="trailing") == [None, 1, 2, 3, 4, 4, 4]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_rows_count_not_days(spark, chunk):
    """Every chunk border falls into a gap; missing calendar days change nothing."""
    df = series(spark, [3.0, None, None, 9.0, None], step=40)
    assert filled(df, chunk=chunk) == [3, 5, 7, 9, 9]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_single_and_empty_series(spark, chunk):
    assert filled(series(spark, [None, None, 7.0, None]), chunk=chunk) == [7, 7, 7, 7]
    assert filled(series(spark, [None, None, None]), chunk=chunk) == [None, None, None]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_equals_brute_force_with_one_hot_series(spark, chunk):
    """One district holds most rows, gaps run over many chunks."""
    rng = random.Random(7)
    data = {
        "hot": [rng.uniform(0, 50) if rng.random() < 0.15 else None for _ in range(900)],
        "cold": [rng.uniform(0, 50) if rng.random() < 0.5 else None for _ in range(40)],
        "gap": [4.0] + [None] * 300 + [10.0],
    }
    rows = [(day(i), name, v) for name, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "date DATE, district_name STRING, rainfall_mm DOUBLE").repartition(5)
    for edges in ("both", "trailing"):
        expected = [x for name in sorted(data) for x in by_hand(data[name], edges == "both")]
        assert filled(df, chunk=chunk, edges=edges) == expected


@pytest.mark.parametrize("chunk", CHUNKS)
def test_same_day_rows_follow_their_files(spark, chunk):
    """A hot day: all rows share one date, ordered by file and position in it."""
    rng = random.Random(3)
    readings = [rng.uniform(0, 9) if rng.random() < 0.3 else None for _ in range(400)]
    rows = [(day(0), "A", f"f{i // 100}.csv", (i % 100 // 10, i), v) for i, v in enumerate(readings)]
    rng.shuffle(rows)
    schema = ("date DATE, district_name STRING, source_file STRING, "
              "file_position STRUCT<block: BIGINT, row: BIGINT>, rainfall_mm DOUBLE")
    result = fill_gaps(spark.createDataFrame(rows, schema), chunk=chunk, runs=4).orderBy("file_position.row").collect()
    assert [r["rainfall_mm"] for r in result] == by_hand(readings)


def test_null_series_key_keeps_row_without_reading(spark):
    rows = [(day(0), None, 5.0), (day(0), "A", 1.0), (day(1), "A", None)]
    df = spark.createDataFrame(rows, "date DATE, district_name STRING, rainfall_mm DOUBLE")
    result = {(r["district_name"], r["date"]): r["rainfall_mm"] for r in fill_gaps(df).collect()}
    assert result == {(None, day(0)): None, ("A", day(0)): 1.0, ("A", day(1)): 1.0}


def test_same_name_in_two_states_shares_a_series(spark):
    rows = [(day(0), "S1", "A", 1.0), (day(1), "S2", "A", None), (day(2), "S1", "A", 5.0)]
    df = spark.createDataFrame(rows, "date DATE, state_name STRING, district_name STRING, rainfall_mm DOUBLE")
    together = {r["date"]: r["rainfall_mm"] for r in fill_gaps(df).collect()}
    assert together[day(1)] == 3.0


def test_ties_are_ordered_by_state_and_value(spark):
    rows = [(day(0), s, "A", v) for s, v in (("S2", None), ("S1", 1.0), ("S3", 7.0), ("S2", 2.0), ("S2", 5.0))]
    schema = "date DATE, state_name STRING, district_name STRING, rainfall_mm DOUBLE"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        result = fill_gaps(spark.createDataFrame(order, schema).repartition(3)).collect()
        # NULL comes first among S2's rows, so it lies between 1 and 2.
        assert sorted(r["rainfall_mm"] for r in result) == [1.0, 1.5, 2.0, 5.0, 7.0]


def test_readings_are_shuffled_once(spark, monkeypatch):
    """What is stored comes from one exchange; what reads it moves chunk edges only."""
    plans = []
    keep = gapfill.stored
    monkeypatch.setattr(gapfill, "stored", lambda df, *a: (plans.append(_plan(df)), keep(df, *a))[1])
    result = fill_gaps(series(spark, [1.0, None, None, 4.0, None] * 20))
    assert plans[0].count("Exchange hashpartitioning") == 1 and plans[0].count("Window [row_number()") == 1
    after = _plan(result)
    assert "row_number()" not in after and "Sort [district_name" not in after.split("Union")[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filled_values_lie_between_neighbours(spark):
    df = series(spark, [2.0, None, 8.0, None, None, 1.0])
    values = filled(df)
    assert 2 <= values[1] <= 8 and 1 <= values[3] <= 8 and 1 <= values[4] <= 8


def test_rows_and_columns_are_kept(spark):
    df = series(spark, [None, 1.0, None]).withColumn("extra", F.lit("x"))
    result = fill_gaps(df)
    assert result.columns == df.columns and result.count() == 3


def test_unknown_options(spark):
    df = series(spark, [1.0])
    with pytest.raises(ValueError):
        fill_gaps(df, chunk="week")
    with pytest.raises(ValueError):
        fill_gaps(df, edges="none")


def test_runs_follow_the_size_of_the_input(spark):
    assert [runs_for(n, 10) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10]
    with pytest.raises(ValueError, match="number of runs"):
        fill_gaps(series(spark, [1.0]), chunk="range")


def raw(spark, rows):
    return spark.createDataFrame(rows, "Date STRING, State STRING, District STRING, Avg_rainfall STRING, Note STRING")


def test_clean_daily(spark):
    df = raw(spark, [
        ("2016-06-02", " telangana", "WARANGAL ", "NA", "b"),
        ("2016-6-1", "Telangana ", "warangal", "-3", "a"),
        ("2016-06-03", "TELANGANA", "Warangal", "5", "c"),
    ])
    result = clean_daily(df)
    assert result.columns == [
        "date", "state_name", "district_name", "rainfall_mm", "Note", "year", "month", "week_number", "season",
    ]
    rows = result.orderBy("date").collect()
    # The gap is filled between -3 and 5 first, then negatives become 0.
    assert [r["rainfall_mm"] for r in rows] == [0.0, 1.0, 5.0]
    assert {(r["state_name"], r["district_name"], r["season"]) for r in rows} == {("Telangana", "Warangal", "Kharif")}


def test_strict_and_quarantine(spark):
    df = raw(spark, [
        ("2016-06-01", "S", "D", "1", None),
        ("01-06-2016", "S", "D", "2", None),
        (None, "S", "D", "2", None),
        ("2016-06-02", "S", "D", "trace", None),
    ])
    with pytest.raises(Exception, match="not a"):
        standardise(df).collect()
    good, rejected = split_rejects(df)
    assert [r["rainfall_mm"] for r in clean_daily(good).collect()] == [1.0]
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["date", "date", "rainfall_mm"]


def test_missing_column(spark):
    with pytest.raises(ValueError, match="rainfall_mm"):
        standardise(spark.createDataFrame([("2016-06-01", "S", "D")], "Date STRING, State STRING, District STRING"))
