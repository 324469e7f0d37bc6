"""Coverage, missing readings and class balance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.functions.numbers import round_even


def coverage_summary(daily: DataFrame) -> DataFrame:
    """Date range and numbers of districts, states and years.

    Counting distinct values of several columns makes Spark copy every input row per
    column, so the rows are first reduced to one per place and year.
    """
    by_place = daily.groupBy("state_name", "district_name", "year").agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )
    return by_place.agg(
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.countDistinct("district_name").alias("n_districts"),
        F.countDistinct("state_name").alias("n_states"),
        F.countDistinct("year").alias("n_years"),
    )


def missing_summary(daily: DataFrame, before: str = "reading_mm", after: str = "rainfall_mm") -> DataFrame:
    """Missing readings before and after filling, as counts and percent of the rows."""
    counts = daily.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col(before).isNull(), 1)).alias("missing_before"),
        F.count(F.when(F.col(after).isNull(), 1)).alias("missing_after"),
    )
    percent = F.try_divide(F.col("missing_before"), F.col("n_rows")) * 100
    return counts.withColumn("missing_before_pct", round_even(percent, 2))


def class_balance(labelled: DataFrame, target: str = "target_above_normal") -> DataFrame:
    counts = labelled.agg(F.count(F.when(F.col(target) == 1, 1)).alias("n_above"), F.count(F.lit(1)).alias("n_rows"))
    share = F.try_divide(F.col("n_above"), F.col("n_rows")) * 100
    return counts.withColumn("above_pct", round_even(share, 1))
