"""Monthly and seasonal totals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvigrid.functions.exact import UNITS, exact_sum, from_units, total_units
from pluvigrid.functions.calendar import assign_season, season_year
from pluvigrid.functions.fixed_values import RAINY_DAY_MM
from pluvigrid.operators.filters import not_null_values

PLACE = ("state_name", "district_name")


def _units(daily: DataFrame, *period: str) -> DataFrame:
    keys = [*PLACE, *period]
    amount = F.col("rainfall_mm")
    return (
        not_null_values(daily, *keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(total_units(amount), F.lit(0).cast(UNITS)).alias("total_units"),
            F.count(F.when(amount > RAINY_DAY_MM, 1)).alias("rainy_days"),
            F.count(amount).alias("data_days"),
        )
    )


def rounded_totals(units: DataFrame) -> DataFrame:
    """``total_rainfall_mm``, the nearest double, in place of exact ``total_units``."""
    total = from_units(F.col("total_units")).alias("total_rainfall_mm")
    return units.select(*(total if c == "total_units" else F.col(c) for c in units.columns))


def monthly_units(daily: DataFrame) -> DataFrame:
    """Exact total, rainy days and days with a reading per district and month."""
    return _units(daily, "year", "month")


def monthly_totals(daily: DataFrame) -> DataFrame:
    return rounded_totals(monthly_units(daily))


def _with_season_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", season_year(F.col("year"), F.col("month"), F.col("season")))


def seasonal_totals(daily: DataFrame) -> DataFrame:
    """The same per season, straight from the daily table."""
    return rounded_totals(_units(_with_season_year(daily), "year", "season"))


def _seasons(monthly: DataFrame, total: Column) -> DataFrame:
    seasons = _with_season_year(monthly.withColumn("season", assign_season(F.col("month"))))
    counts = [F.sum(c).alias(c) for c in ("rainy_days", "data_days")]
    return seasons.groupBy(*PLACE, "year", "season").agg(total, *counts)


def seasonal_units(months: DataFrame) -> DataFrame:
    """Seasons are whole months, so exact month totals give the same seasons as the days.

    About thirty times fewer rows to read than :func:`seasonal_totals`.
    """
    return _seasons(months, F.sum("total_units").cast(UNITS).alias("total_units"))


def seasonal_from_monthly(monthly: DataFrame) -> DataFrame:
    """The same from a month table, whose totals are rounded: the last bit may differ."""
    return _seasons(monthly, exact_sum(F.col("total_rainfall_mm")).alias("total_rainfall_mm"))


def monthly_sorted(monthly: DataFrame) -> DataFrame:
    return monthly.orderBy("district_name", "year", "month", "state_name")


def seasonal_sorted(seasonal: DataFrame) -> DataFrame:
    return seasonal.orderBy("district_name", "year", "season", "state_name")


def preview(df: DataFrame, *order: str) -> DataFrame:
    """The first five rows."""
    return df.orderBy(*order).limit(5)
