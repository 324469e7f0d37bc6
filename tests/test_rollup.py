import datetime

import pytest
from pyspark.sql import functions as F

from pluvigrid.checks import catalog
from pluvigrid.operators import departure, filters, quality, reports, rollup
from pluvigrid.operators.cleaning import add_calendar_parts
from pluvigrid.operators.features import june_lpa
from tests_support import SF


def daily(spark, rows):
    df = spark.createDataFrame(
        [(datetime.date.fromisoformat(d), s, n, v) for d, s, n, v in rows],
        "date DATE, state_name STRING, district_name STRING, rainfall_mm DOUBLE",
    )
    return add_calendar_parts(df)


def months(spark, rows):
    schema = ("state_name STRING, district_name STRING, year INT, month INT, total_rainfall_mm DOUBLE, "
              "rainy_days BIGINT, data_days BIGINT")
    return spark.createDataFrame([("S", n, y, m, t, 0, 30) for n, y, m, t in rows], schema)


def test_rainy_days_and_missing(spark):
    df = daily(spark, [("2020-06-01", "S", "A", 2.5), ("2020-06-02", "S", "A", 2.51), ("2020-06-03", "S", "A", None)])
    row = rollup.monthly_totals(df).first()
    assert (row["total_rainfall_mm"], row["rainy_days"], row["data_days"]) == (5.01, 1, 2)


def test_all_missing_is_zero_and_normal(spark):
    df = daily(spark, [("2020-06-01", "S", "A", None), ("2021-06-01", "S", "A", None)])
    rows = departure.monthly_departure(rollup.monthly_totals(df)).collect()
    assert [(r["total_rainfall_mm"], r["data_days"], r["lpa_mm"], r["departure_pct"], r["anomaly_category"])
            for r in rows] == [(0.0, 0, 0.0, 0.0, "Normal")] * 2


def test_null_keys_are_in_no_total(spark):
    df = daily(spark, [("2020-06-01", "S", None, 1.0), ("2020-06-01", None, "A", 1.0), ("2020-06-01", "S", "A", 1.0)])
    assert rollup.monthly_totals(df).count() == 1


def test_rabi_year(spark):
    df = daily(spark, [("2020-10-01", "S", "A", 1.0), ("2021-02-28", "S", "A", 2.0), ("2021-03-01", "S", "A", 4.0)])
    rows = {(r["year"], r["season"]): r["total_rainfall_mm"] for r in rollup.seasonal_totals(df).collect()}
    assert rows == {(2020, "Rabi"): 3.0, (2021, "Zaid"): 4.0}


def test_seasons_from_months_equal_seasons_from_days(spark):
    df = catalog.daily(spark, SF)
    rounded = lambda t: t.withColumn("total_rainfall_mm", F.round("total_rainfall_mm", 6))
    a, b = rounded(rollup.seasonal_totals(df)), rounded(rollup.seasonal_from_monthly(rollup.monthly_totals(df)))
    assert a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_lpa_and_departure(spark):
    df = months(spark, [("A", 2018, 7, 100.0), ("A", 2019, 7, 200.0), ("A", 2020, 7, 300.0)])
    rows = departure.monthly_departure(df).orderBy("year").collect()
    assert [r["departure_pct"] for r in rows] == [-50.0, 0.0, 50.0]
    assert {r["lpa_mm"] for r in rows} == {200.0}
    assert [r["anomaly_category"] for r in rows] == ["Large Deficit", "Normal", "Large Excess"]


def test_class_uses_the_rounded_departure(spark):
    df = months(spark, [("A", 2018, 7, 105.004)]).withColumn("lpa_mm", F.lit(100.0))
    row = departure.flag_above_normal(departure.measure_departure(df)).first()
    assert (row["departure_pct"], row["anomaly_category"], row["is_above_normal"]) == (5.0, "Normal", 0)


def test_join_form_equals_window_form(spark):
    totals = catalog.monthly(spark, SF)
    joined = departure.measure_departure(departure.attach_lpa(totals, departure.monthly_lpa(totals)))
    window = departure.monthly_departure(totals).select(joined.columns)
    assert joined.exceptAll(window).isEmpty() and joined.count() == window.count()


def test_same_name_in_two_states_shares_the_lpa(spark):
    rows = months(spark, [("A", 2018, 7, 100.0)]).union(
        months(spark, [("A", 2018, 7, 300.0)]).withColumn("state_name", F.lit("T")))
    assert {r["lpa_mm"] for r in departure.monthly_departure(rows).collect()} == {200.0}


def test_probability(spark):
    rows = [("A", "Kharif", f) for f in (1, 0, 0)] + [(None, "Kharif", 1)]
    df = spark.createDataFrame(rows, "district_name STRING, season STRING, is_above_normal INT")
    assert [tuple(r) for r in departure.above_normal_probability(df).collect()] == [("A", "Kharif", 1, 3, 33.3)]


def test_chain_properties(spark):
    monthly = catalog.monthly_dep(spark, SF)
    seasonal = catalog.seasonal_dep(spark, SF)
    total = lambda df: df.agg(F.sum("total_rainfall_mm")).first()[0]
    assert total(monthly) == pytest.approx(total(seasonal))
    unrounded = (F.col("total_rainfall_mm") - F.col("lpa_mm")) / F.col("lpa_mm")
    means = monthly.where("lpa_mm > 0").groupBy("district_name", "month").agg(F.avg(unrounded).alias("m"))
    assert means.agg(F.max(F.abs("m"))).first()[0] < 0.01
    odds = departure.above_normal_probability(seasonal)
    assert odds.where("years_above_normal > total_years or prob_above_normal_pct not between 0 and 100").isEmpty()


def test_repartitioning_changes_nothing(spark):
    raw = catalog.raw_readings(spark, SF)
    a = catalog.clean_daily(raw.repartition(1))
    b = catalog.clean_daily(raw.repartition(13, "Avg_rainfall"))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_coverage_and_missing(spark):
    df = daily(spark, [("2020-06-01", "S", "A", None), ("2021-06-03", "T", "A", 1.0), ("2021-06-02", "T", None, None)])
    row = quality.coverage_summary(df).first()
    assert tuple(row) == (datetime.date(2020, 6, 1), datetime.date(2021, 6, 3), 1, 2, 2)
    counts = quality.missing_summary(df.withColumn("reading_mm", F.col("rainfall_mm"))).first()
    assert tuple(counts) == (3, 2, 2, 66.67)


def test_lists(spark):
    df = spark.createDataFrame([("T", "B"), ("S", "C"), ("S", "A"), ("S", "A"), (None, "Z"), ("S", None)],
                               "state_name STRING, district_name STRING")
    assert [r[0] for r in filters.list_states(df).collect()] == ["S", "T"]
    assert [r[1] for r in filters.list_districts(df, "S").collect()] == ["A", "C"]
    assert filters.list_districts(df).count() == 3


def seasons(spark, rows):
    schema = ("state_name STRING, district_name STRING, year INT, season STRING, total_rainfall_mm DOUBLE, "
              "lpa_mm DOUBLE, departure_pct DOUBLE, anomaly_category STRING")
    return spark.createDataFrame([(s, n, y, w, t, l, d, "Normal") for s, n, y, w, t, l, d in rows], schema)


def test_latest_season_and_trend(spark):
    df = seasons(spark, [
        ("T", "A", 2020, "Kharif", 90.0, 100.5, -10.0), ("S", "A", 2020, "Kharif", 120.0, 100.0, 20.0),
        ("S", "A", 2019, "Kharif", 100.5, 100.5, 0.0), ("S", "A", 2021, "Rabi", 1.0, 1.0, 0.0),
    ])
    assert tuple(reports.last_season(df).first()) == ("A", 2020, 120.0, 20.0, 100.0)
    assert tuple(reports.lpa_of_series(df).first()) == ("A", 100.5)
    trend = reports.rainfall_trend(df).collect()
    assert [(r["year"], r["vs_lpa"], r["total_text"]) for r in trend] == [
        (2019, "above", "100"), (2020, "above", "120"), (2020, "below", "90")]


def test_overview_without_kharif_or_odds(spark):
    df = seasons(spark, [("S", "A", 2021, "Rabi", 1.0, 1.0, 0.0)])
    odds = spark.createDataFrame([], "district_name STRING, season STRING, years_above_normal BIGINT, "
                                     "total_years BIGINT, prob_above_normal_pct DOUBLE")
    row = reports.district_overview(df, odds).first()
    assert (row["primary_prob"], row["primary_colour"], row["primary_text"]) == (50.0, "blue", "50%")
    assert row["last_year"] is None and row["departure_text"] is None


def test_departure_matrix(spark):
    df = spark.createDataFrame([("A", 1, 2019, 4.0), ("A", 1, 2019, 6.0), ("A", 2, 2020, -1.0)],
                               "district_name STRING, month INT, year INT, departure_pct DOUBLE")
    assert reports.departure_years(df) == [2019, 2020]
    rows = [tuple(r) for r in reports.departure_matrix(df, [2019, 2020]).collect()]
    assert rows == [("A", 1, 5.0, None, "Jan"), ("A", 2, None, -1.0, "Feb")]


def test_june_defaults(spark):
    places = seasons(spark, [("S", "A", 2020, "Kharif", 1.0, 1.0, 0.0), ("S", "B", 2020, "Kharif", 1.0, 1.0, 0.0)])
    june = spark.createDataFrame([("A", 6, 10.35), ("A", 7, 99.0)], "district_name STRING, month INT, lpa_mm DOUBLE")
    rows = reports.input_defaults(places, june_lpa(june)).collect()
    assert [(r["june_default_mm"], r["june_help"]) for r in rows] == [
        (round(10.35, 1), "Historical June LPA for A: 10.3 mm"), (100.0, "Historical June LPA for B: 100.0 mm")]
