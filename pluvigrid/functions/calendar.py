"""Dates, seasons and calendar parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvigrid.functions.fixed_values import KHARIF_MONTHS, RABI_MONTHS


def parse_date(text: Column) -> Column:
    """Year-month-day text to DATE, NULL when it is anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def parse_date_strict(text: Column) -> Column:
    """Like :func:`parse_date`, but a missing or malformed date stops the job."""
    parsed = parse_date(text)
    message = F.concat(F.lit("not a YYYY-MM-DD date: "), F.coalesce(text, F.lit("<missing>")))
    return F.coalesce(parsed, F.raise_error(message).cast("date"))


def iso_week(date: Column) -> Column:
    return F.weekofyear(date)


def assign_season(month: Column) -> Column:
    return (
        F.when(month.isin(*KHARIF_MONTHS), F.lit("Kharif"))
        .when(month.isin(*RABI_MONTHS), F.lit("Rabi"))
        .otherwise(F.lit("Zaid"))
    )


def season_year(year: Column, month: Column, season: Column) -> Column:
    """January and February belong to the Rabi season that began the year before."""
    return F.when((season == "Rabi") & (month <= 2), year - 1).otherwise(year)


def month_label(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")
