"""Report tables, each for all districts at once; filter for a single one."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvigrid.functions.calendar import month_label
from pluvigrid.functions.classes import (
    departure_colour,
    departure_text,
    forecast_category,
    low_accuracy,
    outlook_colour,
    outlook_points,
    outlook_title,
    vs_lpa,
)
from pluvigrid.functions.fixed_values import DEFAULT_PROBABILITY_PCT, FORECAST_BANDS, TARGET_SEASON
from pluvigrid.functions.numbers import format_fixed, round_exact
from pluvigrid.operators.features import june_default
from pluvigrid.operators.filters import filter_season, not_null_values
from pluvigrid.operators.lookup import lookup


def _is_kharif():
    return F.col("season") == TARGET_SEASON


def _latest_kharif():
    """Values of the latest Kharif row; states of one year in alphabetical order."""
    newest_first = F.when(_is_kharif(), F.struct(-F.col("year"), F.col("state_name")))
    row = F.struct("year", "total_rainfall_mm", "departure_pct", "lpa_mm")
    return F.min_by(row, newest_first)


def _unpack_latest(df: DataFrame) -> DataFrame:
    return df.select(
        "district_name",
        F.col("latest.year").alias("last_year"),
        F.col("latest.total_rainfall_mm").alias("last_total_mm"),
        F.col("latest.departure_pct").alias("last_departure_pct"),
        F.col("latest.lpa_mm").alias("last_lpa_mm"),
    )


def last_season(seasonal: DataFrame) -> DataFrame:
    """The latest Kharif season of each district, by an aggregate and not by a sort."""
    kharif = filter_season(seasonal, TARGET_SEASON)
    return _unpack_latest(kharif.groupBy("district_name").agg(_latest_kharif().alias("latest")))


def lpa_of_series(seasonal: DataFrame) -> DataFrame:
    """The Kharif LPA on each district's earliest row."""
    kharif = filter_season(seasonal, TARGET_SEASON)
    return kharif.groupBy("district_name").agg(
        F.min_by("lpa_mm", F.struct("year", "state_name")).alias("series_lpa_mm")
    )


def rainfall_trend(seasonal: DataFrame) -> DataFrame:
    """Kharif totals by year against the district's LPA."""
    kharif = filter_season(seasonal, TARGET_SEASON)
    earliest = Window.partitionBy("district_name").orderBy("year", "state_name")
    lpa = F.first("lpa_mm").over(earliest)
    return (
        kharif.withColumn("series_lpa_mm", lpa)
        .select(
            "district_name",
            "state_name",
            "year",
            "total_rainfall_mm",
            "series_lpa_mm",
            vs_lpa(F.col("total_rainfall_mm"), F.col("series_lpa_mm")).alias("vs_lpa"),
            format_fixed(F.col("total_rainfall_mm"), 0).alias("total_text"),
        )
        .orderBy("district_name", "year", "state_name")
    )


def departure_matrix(monthly: DataFrame, years: Sequence[int]) -> DataFrame:
    """Mean departure, one row per district and month, one column per listed year."""
    return (
        monthly.groupBy("district_name", "month")
        .pivot("year", list(years))
        .agg(F.avg("departure_pct"))
        .withColumn("month_label", month_label(F.col("month")))
        .orderBy("district_name", "month")
    )


def departure_years(monthly: DataFrame) -> list[int]:
    """The calendar years present, for :func:`departure_matrix`."""
    return [row[0] for row in monthly.select("year").distinct().orderBy("year").collect()]


def district_seasonal_table(seasonal: DataFrame) -> DataFrame:
    """All seasons with their display texts."""
    return seasonal.select(
        "district_name",
        "state_name",
        "year",
        "season",
        format_fixed(F.col("total_rainfall_mm"), 1).alias("total_text"),
        format_fixed(F.col("lpa_mm"), 1).alias("lpa_text"),
        format_fixed(F.col("departure_pct"), 1, plus=True, suffix="%").alias("departure_text"),
        "anomaly_category",
    ).orderBy("district_name", "year", "season", "state_name")


def compare_districts(probability: DataFrame) -> DataFrame:
    """Districts by Kharif above-normal odds, highest first."""
    odds = F.col("prob_above_normal_pct")
    return (
        filter_season(probability, TARGET_SEASON)
        .select(
            "district_name",
            odds,
            outlook_colour(odds).alias("colour"),
            format_fixed(odds, 0, suffix="%").alias("odds_text"),
        )
        .orderBy(F.desc("prob_above_normal_pct"), "district_name")
    )


def probability_lookup(districts: DataFrame, probability: DataFrame) -> DataFrame:
    """Kharif odds of each listed district, 50 % where there are none."""
    kharif = filter_season(probability, TARGET_SEASON).drop("season")
    found = lookup(districts, kharif, "district_name")
    return found.select(
        *districts.columns,
        "years_above_normal",
        "total_years",
        F.coalesce("prob_above_normal_pct", F.lit(DEFAULT_PROBABILITY_PCT)).alias("primary_prob"),
    )


MODEL_COLUMNS = {
    "state_name": "string",
    "june_rainfall_mm": "double",
    "model_prob": "double",
    "model_colour": "string",
    "model_text": "string",
    "model_accuracy": "double",
    "low_accuracy": "boolean",
}


def district_overview(seasonal: DataFrame, probability: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Odds, latest season and the model's forecasts for every district; without ``scores`` these are NULL."""
    listed = seasonal.where(F.col("district_name").isNotNull())
    latest = _unpack_latest(listed.groupBy("district_name").agg(_latest_kharif().alias("latest")))
    odds, departure = F.col("primary_prob"), F.col("last_departure_pct")
    cards = probability_lookup(latest, probability).withColumns(
        {
            "primary_colour": outlook_colour(odds),
            "primary_text": format_fixed(odds, 0, suffix="%"),
            "departure_colour": departure_colour(departure),
            "departure_text": departure_text(departure),
            "last_total_text": format_fixed(F.col("last_total_mm"), 0),
            "last_lpa_text": format_fixed(F.col("last_lpa_mm"), 0),
        }
    )
    if scores is None:
        return cards.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in MODEL_COLUMNS.items()))
    forecast = scores.where(F.col("error").isNull()).select(
        F.col("district").alias("district_name"),
        F.col("state").alias("state_name"),
        "june_rainfall_mm",
        F.col("probability").alias("model_prob"),
        outlook_colour(F.col("probability")).alias("model_colour"),
        format_fixed(F.col("probability"), 0, suffix="%").alias("model_text"),
        "model_accuracy",
        low_accuracy(F.col("model_accuracy") / 100).alias("low_accuracy"),
    )
    # Requests are the large side: their lookup spreads a popular district.
    listed_cards = cards.withColumn("listed", F.lit(True))
    asked = lookup(forecast, listed_cards, "district_name").where("listed").select(*cards.columns, *MODEL_COLUMNS)
    silent = cards.join(forecast.select("district_name").distinct(), "district_name", "left_anti")
    return asked.unionByName(silent, allowMissingColumns=True)


def forecast_bands(spark: SparkSession) -> DataFrame:
    """The four forecast categories with colour and advice."""
    rows = [band[1:] for band in FORECAST_BANDS]
    return spark.createDataFrame(rows, "category STRING, colour STRING, advice STRING")


def advice_lookup(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Category of a 0..1 probability, then its colour and advice from the four-row table."""
    banded = scored.withColumn("category", forecast_category(F.col(probability)))
    bands = forecast_bands(scored.sparkSession)
    return banded.join(F.broadcast(bands), "category", "left").select(*banded.columns, "colour", "advice")


def advice_points(districts: DataFrame, probability: DataFrame) -> DataFrame:
    """Outlook per district with its advice points as an array."""
    odds = F.col("primary_prob")
    return probability_lookup(districts, probability).select(
        "district_name",
        odds,
        outlook_colour(odds).alias("colour"),
        outlook_title(odds).alias("title"),
        outlook_points(odds, F.col("district_name")).alias("points"),
    )


def farmer_advice(districts: DataFrame, probability: DataFrame) -> DataFrame:
    """One row per district and advice point, numbered from 1."""
    advice = advice_points(districts, probability)
    kept = [F.col(c) for c in advice.columns if c != "points"]
    numbered = advice.select(*kept, F.posexplode("points").alias("position", "point"))
    return numbered.withColumn("point_no", F.col("position") + 1).drop("position")


def input_defaults(seasonal: DataFrame, lpa: DataFrame) -> DataFrame:
    """Selectable states and districts with the suggested June total, from :func:`june_lpa`."""
    places = not_null_values(seasonal.select("state_name", "district_name"), "state_name", "district_name").distinct()
    found = june_default(lpa, places)
    return found.select(
        "state_name",
        "district_name",
        round_exact(F.col("june_lpa_mm")).alias("june_default_mm"),
        F.concat(
            F.lit("Historical June LPA for "),
            F.col("district_name"),
            F.lit(": "),
            format_fixed(F.col("june_lpa_mm"), 1),
            F.lit(" mm"),
        ).alias("june_help"),
    ).orderBy("state_name", "district_name")
