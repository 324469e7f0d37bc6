"""Row filters and lists of names; plain predicates that reach the Parquet scan."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_season(df: DataFrame, season: str) -> DataFrame:
    return df.where(F.col("season") == season)


def filter_month(df: DataFrame, month: int) -> DataFrame:
    return df.where(F.col("month") == month)


def filter_district(df: DataFrame, district: str) -> DataFrame:
    return df.where(F.col("district_name") == district)


def filter_district_season(df: DataFrame, district: str, season: str) -> DataFrame:
    return filter_season(filter_district(df, district), season)


def filter_district_month(df: DataFrame, district: str, month: int) -> DataFrame:
    return filter_month(filter_district(df, district), month)


def not_null_values(df: DataFrame, *columns: str) -> DataFrame:
    """Plain IS NOT NULL tests: unlike those of ``dropna`` they reach the scan."""
    return df.where(reduce(and_, (F.col(c).isNotNull() for c in columns)))


def list_values(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted distinct combinations without missing parts."""
    return not_null_values(df.select(*columns), *columns).distinct().orderBy(*columns)


def list_states(df: DataFrame) -> DataFrame:
    return list_values(df, "state_name")


def list_districts(df: DataFrame, state: str | None = None) -> DataFrame:
    """Districts of one state, or of every state."""
    rows = df if state is None else df.where(F.col("state_name") == state)
    return list_values(rows, "state_name", "district_name")


def list_years(df: DataFrame) -> DataFrame:
    return list_values(df, "year")
