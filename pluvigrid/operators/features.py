"""Feature matrix of the season forecast, for training and for serving."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvigrid.functions.classes import above_normal_flag
from pluvigrid.functions.exact import deviation, exact_avg
from pluvigrid.functions.fixed_values import (
    DEFAULT_CV,
    DEFAULT_JUNE_LPA_MM,
    DEFAULT_JUNE_RATIO,
    DEFAULT_MEAN_MM,
    DEFAULT_STATE_CODE,
    DEFAULT_STD_MM,
    JUNE_INPUT_MAX_MM,
    JUNE_INPUT_MIN_MM,
    PREDICTOR_MONTH,
    TARGET_SEASON,
)
from pluvigrid.functions.numbers import departure_pct, ratio, round_even
from pluvigrid.operators.filters import filter_month, filter_season, not_null_values
from pluvigrid.operators.lookup import lookup
from pluvigrid.operators.ordering import label_codes

KEYS = ("district_name", "state_name", "year")


def kharif_target(seasonal: DataFrame) -> DataFrame:
    """Kharif rows with the class to predict."""
    kharif = filter_season(seasonal, TARGET_SEASON)
    return kharif.withColumn("target_above_normal", above_normal_flag(F.col("departure_pct")))


def june_rows(monthly: DataFrame) -> DataFrame:
    return filter_month(monthly, PREDICTOR_MONTH).select(
        "district_name",
        "year",
        F.col("total_rainfall_mm").alias("june_rainfall_mm"),
        F.col("departure_pct").alias("june_departure_pct"),
    )


def district_stats(kharif: DataFrame) -> DataFrame:
    """Mean, sample deviation and their ratio per district; one year has no deviation."""
    total = F.col("total_rainfall_mm")
    # A district has one row per year and state. Deviations are taken from the mean, in a second look at them.
    mean = exact_avg(total, Window.partitionBy("district_name"))
    return (
        kharif.where(F.col("district_name").isNotNull())
        .withColumn("__mean", mean)
        .groupBy("district_name")
        .agg(F.max("__mean").alias("district_mean_mm"), deviation(total, F.col("__mean")).alias("district_std_mm"))
        .withColumn("district_cv", ratio(F.col("district_std_mm"), F.col("district_mean_mm")))
    )


def june_lpa(monthly: DataFrame) -> DataFrame:
    """Mean stored June LPA per district."""
    june = filter_month(monthly, PREDICTOR_MONTH).where(F.col("district_name").isNotNull())
    return june.groupBy("district_name").agg(exact_avg(F.col("lpa_mm")).alias("june_lpa_mm"))


def june_features_join(kharif: DataFrame, june: DataFrame) -> DataFrame:
    rows = kharif.select(*KEYS, "target_above_normal")
    return rows.join(june, ["district_name", "year"], "left").select(
        *rows.columns, "june_rainfall_mm", "june_departure_pct"
    )


def district_stats_join(features: DataFrame, stats: DataFrame) -> DataFrame:
    """No broadcast hint: the number of districts has no fixed bound, so Spark decides."""
    return features.join(stats, "district_name", "left").select(
        *features.columns, *(c for c in stats.columns if c != "district_name")
    )


def june_signals(features: DataFrame) -> DataFrame:
    compared = ratio(F.col("june_rainfall_mm"), F.col("district_mean_mm"))
    return features.withColumn("june_vs_district_mean", round_even(compared, 4)).withColumn(
        "june_was_above_normal", above_normal_flag(F.col("june_departure_pct"))
    )


def district_codes(seasonal: DataFrame) -> DataFrame:
    return label_codes(filter_season(seasonal, TARGET_SEASON), "district_name", "district_encoded")


def state_codes(seasonal: DataFrame) -> DataFrame:
    return label_codes(filter_season(seasonal, TARGET_SEASON), "state_name", "state_encoded")


def drop_missing_june(features: DataFrame) -> DataFrame:
    return not_null_values(features, "june_rainfall_mm", "june_departure_pct")


def season_rows(
    seasonal: DataFrame,
    monthly: DataFrame,
    codes: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per district and year: what is known after June, and the season's class.

    Codes number all Kharif districts and states, also those whose rows have no June
    readings. Pass ``codes`` to reuse stored ones.
    """
    districts, states = codes or (district_codes(seasonal), state_codes(seasonal))
    kharif = kharif_target(seasonal)
    joined = june_features_join(kharif, june_rows(monthly))
    profile = district_stats(kharif).join(districts, "district_name", "left")
    known = june_signals(district_stats_join(joined, profile)).join(states, "state_name", "left")
    return known.select(
        *KEYS,
        "target_above_normal",
        "june_rainfall_mm",
        "june_departure_pct",
        "district_mean_mm",
        "district_std_mm",
        "district_cv",
        "june_vs_district_mean",
        "june_was_above_normal",
        "district_encoded",
        "state_encoded",
    )


def feature_matrix(
    seasonal: DataFrame,
    monthly: DataFrame,
    codes: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The :func:`season_rows` that have June readings."""
    return drop_missing_june(season_rows(seasonal, monthly, codes))


def balanced_weights(
    features: DataFrame, target: str = "target_above_normal", times: Column | None = None
) -> DataFrame:
    """Adds ``class_weight`` = rows / (classes * rows of the class); with ``times``, a row counts so often."""
    sizes = features.groupBy(target).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("n"))
    # One row per class, so two at most.
    classes = Window.partitionBy(F.lit(0))
    weight = F.sum("n").over(classes) / (F.count("n").over(classes) * F.col("n"))
    weights = sizes.select(target, weight.alias("class_weight"))
    return features.join(F.broadcast(weights), target, "left").select(*features.columns, "class_weight")


def validate_june_input(requests: DataFrame) -> DataFrame:
    """``input_error`` says why a June total is refused, NULL when it is in range."""
    fits = F.col("june_rainfall_mm").between(JUNE_INPUT_MIN_MM, JUNE_INPUT_MAX_MM)
    limits = f"June rainfall must be between {JUNE_INPUT_MIN_MM:.0f} and {JUNE_INPUT_MAX_MM:.0f} mm"
    return requests.withColumn("input_error", F.when(F.coalesce(fits, F.lit(False)), None).otherwise(F.lit(limits)))


def known_district(requests: DataFrame, districts: DataFrame) -> DataFrame:
    """Adds the district's code and whether it was in the training data."""
    return lookup(requests, districts, "district_name").withColumn(
        "district_known", F.col("district_encoded").isNotNull()
    )


def score_lookup(
    requests: DataFrame, districts: DataFrame, states: DataFrame, stats: DataFrame, lpa: DataFrame
) -> DataFrame:
    """Requests with all that is stored about their district and state.

    The district dimensions share their key, so they are joined first: requests are
    shuffled once per key and not once per dimension.
    """
    profile = (
        districts.join(stats.withColumn("has_stats", F.lit(True)), "district_name", "left")
        .join(lpa, "district_name", "left")
    )
    found = lookup(lookup(requests, profile, "district_name"), states, "state_name")
    return found.select(
        *requests.columns,
        "district_encoded",
        F.col("district_encoded").isNotNull().alias("district_known"),
        "state_encoded",
        F.col("state_encoded").isNotNull().alias("state_known"),
        F.coalesce("has_stats", F.lit(False)).alias("has_stats"),
        "district_mean_mm",
        "district_std_mm",
        "june_lpa_mm",
    )


def default_values(found: DataFrame) -> DataFrame:
    """Fallbacks for what the lookup did not find."""
    mean = F.coalesce("district_mean_mm", F.lit(DEFAULT_MEAN_MM))
    std = F.when(F.col("has_stats"), F.col("district_std_mm")).otherwise(F.lit(DEFAULT_STD_MM))
    return (
        found.withColumns({"district_mean_mm": mean, "district_std_mm": std})
        .withColumns(
            {
                "district_cv": F.when(
                    F.col("district_mean_mm") > 0, F.try_divide("district_std_mm", "district_mean_mm")
                ).otherwise(F.lit(DEFAULT_CV)),
                "june_lpa_mm": F.coalesce("june_lpa_mm", F.col("district_mean_mm") / 4),
                "state_encoded": F.coalesce("state_encoded", F.lit(DEFAULT_STATE_CODE)),
            }
        )
        .drop("has_stats")
    )


def serving_features(found: DataFrame) -> DataFrame:
    """Model inputs for requests. Unlike in training, nothing is rounded."""
    june, mean = F.col("june_rainfall_mm"), F.col("district_mean_mm")
    return (
        default_values(found)
        .withColumn("june_departure_pct", departure_pct(june, F.col("june_lpa_mm")))
        .withColumn(
            "june_vs_district_mean",
            F.when(mean > 0, F.try_divide(june, mean)).otherwise(F.lit(DEFAULT_JUNE_RATIO)),
        )
        .withColumn("june_was_above_normal", above_normal_flag(F.col("june_departure_pct")))
    )


def june_default(lpa: DataFrame, districts: DataFrame) -> DataFrame:
    """The June LPA of each listed district, or the fallback."""
    return districts.join(lpa, "district_name", "left").withColumn(
        "june_lpa_mm", F.coalesce("june_lpa_mm", F.lit(DEFAULT_JUNE_LPA_MM))
    )
