"""Long period averages, departures from them, and above-normal odds."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvigrid.functions.classes import above_normal_flag, classify_anomaly
from pluvigrid.functions.exact import exact_avg
from pluvigrid.functions.numbers import departure_pct, round_even
from pluvigrid.operators.filters import not_null_values


def _lpa(totals: DataFrame, period: str) -> DataFrame:
    return totals.groupBy("district_name", period).agg(exact_avg(F.col("total_rainfall_mm")).alias("lpa_mm"))


def monthly_lpa(monthly: DataFrame) -> DataFrame:
    return _lpa(monthly, "month")


def seasonal_lpa(seasonal: DataFrame) -> DataFrame:
    return _lpa(seasonal, "season")


def attach_lpa(totals: DataFrame, lpa: DataFrame) -> DataFrame:
    """Left join of totals to a stored LPA table on the columns they share."""
    keys = [c for c in lpa.columns if c != "lpa_mm"]
    return totals.join(lpa, keys, "left").select(*totals.columns, "lpa_mm")


def measure_departure(totals_with_lpa: DataFrame) -> DataFrame:
    """Departure from the exact LPA; class from the rounded departure; LPA rounded last."""
    departure = departure_pct(F.col("total_rainfall_mm"), F.col("lpa_mm"))
    return (
        totals_with_lpa.withColumn("departure_pct", round_even(departure, 2))
        .withColumn("lpa_mm", round_even(F.col("lpa_mm"), 2))
        .withColumn("anomaly_category", classify_anomaly(F.col("departure_pct")))
    )


def _departure(totals: DataFrame, period: str) -> DataFrame:
    # A group holds one total per year (and state of the same district name): it does
    # not grow with the number of readings, so a window is cheaper than a self-join.
    same_period = Window.partitionBy("district_name", period)
    return measure_departure(totals.withColumn("lpa_mm", exact_avg(F.col("total_rainfall_mm"), same_period)))


def monthly_departure(monthly: DataFrame) -> DataFrame:
    return _departure(monthly, "month")


def seasonal_departure(seasonal: DataFrame) -> DataFrame:
    return _departure(seasonal, "season")


def flag_above_normal(seasonal: DataFrame) -> DataFrame:
    return seasonal.withColumn("is_above_normal", above_normal_flag(F.col("departure_pct")))


def above_normal_probability(seasonal_flagged: DataFrame) -> DataFrame:
    """Share of years in which each district's season was above normal."""
    keys = ["district_name", "season"]
    counts = not_null_values(seasonal_flagged, *keys).groupBy(*keys).agg(
        F.sum("is_above_normal").alias("years_above_normal"),
        F.count("is_above_normal").alias("total_years"),
    )
    share = F.col("years_above_normal") / F.col("total_years") * 100
    return counts.withColumn("prob_above_normal_pct", round_even(share, 1))
