"""Sums that do not depend on the order of addition, against exact fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pluvigrid.functions.exact import deviation, exact_avg, exact_sum
from pluvigrid.operators import departure, features, rollup


def rounded(value: Fraction) -> float:
    return value.numerator / value.denominator


CASES = {
    "cancelling": [1e18, 1.0, -1e18, 2**-40],
    "decimals": [0.1] * 1000 + [0.2, 0.3],
    "signs": [-0.1, 0.1, -7.25, 3.5],
    "small": [2.0**-60, 3 * 2.0**-65],
    "one": [1 / 3],
    "zeros": [0.0, -0.0],
}


@pytest.mark.parametrize("name", CASES)
def test_sum_is_the_nearest_double(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    assert df.agg(exact_sum(F.col("x"))).first()[0] == rounded(sum(map(Fraction, values)))


def test_layout_changes_nothing(spark):
    """Plain sums of these rows differ between layouts; exact ones never do."""
    rng = random.Random(4)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(3000)]
    want = rounded(sum(map(Fraction, values)))
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "x DOUBLE, k INT")
    for parts in (1, 2, 7):
        assert df.repartition(parts).agg(exact_sum(F.col("x"))).first()[0] == want
    window = Window.partitionBy("k")
    both = df.withColumn("w", exact_avg(F.col("x"), window)).groupBy("k").agg(F.max("w").alias("w"), exact_avg(F.col("x")).alias("a"))
    assert all(r["w"] == r["a"] for r in both.collect())


def test_missing_values(spark):
    df = spark.createDataFrame([(None, 1), (2.0, 2), (None, 2)], "x DOUBLE, k INT")
    found = {r["k"]: tuple(r)[1:] for r in df.groupBy("k").agg(exact_sum(F.col("x")), exact_avg(F.col("x"))).collect()}
    assert found == {1: (None, None), 2: (2.0, 2.0)}


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 1e60])
def test_what_cannot_be_summed_stops_the_job(spark, value):
    df = spark.createDataFrame([(value,)], "x DOUBLE")
    with pytest.raises(Exception, match="OVERFLOW|overflow|NUMERIC_VALUE_OUT_OF_RANGE"):
        df.agg(exact_sum(F.col("x"))).collect()


def test_deviation(spark):
    df = spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "x DOUBLE")
    one = df.agg(deviation(F.col("x"), F.lit(200.0)), deviation(F.col("x"), F.lit(200.0), sample=False)).first()
    assert one[0] == 100.0 and one[1] == pytest.approx(81.6496580927726)
    assert df.limit(1).agg(deviation(F.col("x"), F.lit(100.0))).first()[0] is None


def test_totals_do_not_depend_on_the_layout(spark):
    rng = random.Random(8)
    rows = [("S", f"D{i % 2}", 2000 + i % 4, 1 + i % 12, rng.uniform(0, 50) / 3) for i in range(2000)]
    daily = spark.createDataFrame(rows, "state_name STRING, district_name STRING, year INT, month INT, rainfall_mm DOUBLE")

    def all_of(df):
        months = rollup.monthly_units(df)
        monthly = departure.monthly_departure(rollup.rounded_totals(months))
        seasons = departure.seasonal_departure(rollup.rounded_totals(rollup.seasonal_units(months)))
        stats = features.district_stats(features.kharif_target(seasons))
        direct = rollup.seasonal_totals(df.withColumn("season", F.expr(
            "CASE WHEN month BETWEEN 6 AND 9 THEN 'Kharif' WHEN month BETWEEN 3 AND 5 THEN 'Zaid' ELSE 'Rabi' END")))
        return [sorted(map(tuple, t.collect())) for t in (monthly, seasons, stats, direct)]

    one, other = all_of(daily.coalesce(1)), all_of(daily.orderBy(F.rand(3)).repartition(9))
    assert one == other
    # Seasons from exact months are those from the days.
    assert [r[:5] for r in one[1]] == [r[:5] for r in one[3]]
