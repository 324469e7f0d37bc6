"""Labels, flags and bands derived from amounts and probabilities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvigrid.functions.fixed_values import (
    ABOVE_NORMAL_PCT,
    FORECAST_BANDS,
    LOW_ACCURACY_PCT,
    OUTLOOK_BANDS,
    VERDICTS,
)
from pluvigrid.functions.numbers import format_fixed


def classify_anomaly(departure: Column) -> Column:
    """Five anomaly classes from a departure already rounded to two places."""
    return (
        F.when(departure > 20, F.lit("Large Excess"))
        .when(departure > 5, F.lit("Above Normal"))
        .when(departure >= -5, F.lit("Normal"))
        .when(departure >= -20, F.lit("Below Normal"))
        .otherwise(F.lit("Large Deficit"))
    )


def above_normal_flag(departure: Column) -> Column:
    """1 when the departure clears the above-normal threshold, else (or missing) 0."""
    return F.when(departure > ABOVE_NORMAL_PCT, F.lit(1)).otherwise(F.lit(0))


def pick_band(value: Column, bands: list[tuple], pick) -> Column:
    """The picked entry of the first band whose lower limit the value reaches."""
    *limited, last = bands
    chosen = F
    for band in limited:
        chosen = chosen.when(value >= band[0], pick(band))
    return F.when(value.isNotNull(), chosen.otherwise(pick(last)))


def forecast_category(probability: Column) -> Column:
    return pick_band(probability, FORECAST_BANDS, lambda band: F.lit(band[1]))


def forecast_colour(probability: Column) -> Column:
    return pick_band(probability, FORECAST_BANDS, lambda band: F.lit(band[2]))


def forecast_advice(probability: Column) -> Column:
    return pick_band(probability, FORECAST_BANDS, lambda band: F.lit(band[3]))


def outlook_colour(percent: Column) -> Column:
    return pick_band(percent, OUTLOOK_BANDS, lambda band: F.lit(band[1]))


def outlook_title(percent: Column) -> Column:
    return pick_band(percent, OUTLOOK_BANDS, lambda band: F.lit(band[2]))


def outlook_points(percent: Column, district: Column) -> Column:
    """Advice points as an array, the district named in the first one."""

    def points(band):
        before, after = band[3][0].split("%s")
        first = F.concat(F.lit(before), district, F.lit(after))
        return F.array(first, *(F.lit(point) for point in band[3][1:]))

    return pick_band(percent, OUTLOOK_BANDS, points)


def vs_lpa(total: Column, lpa: Column) -> Column:
    return F.when(total >= lpa, F.lit("above")).otherwise(F.lit("below"))


def departure_colour(departure: Column) -> Column:
    return F.when(
        departure.isNotNull(),
        F.when(departure > 5, F.lit("green")).when(departure < -5, F.lit("red")).otherwise(F.lit("orange")),
    )


def departure_text(departure: Column) -> Column:
    """Whole percent with a plus sign for any positive departure."""
    sign = F.when(departure > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, format_fixed(departure, 0, suffix="%"))


def score_verdict(accuracy: Column) -> Column:
    return pick_band(accuracy, VERDICTS, lambda band: F.lit(band[1]))


def low_accuracy(accuracy: Column) -> Column:
    return accuracy * 100 < LOW_ACCURACY_PCT
