"""Raw readings to a clean daily table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvigrid.functions import calendar, numbers, text
from pluvigrid.functions.fixed_values import RAW_COLUMNS, SURPLUS
from pluvigrid.operators.gapfill import fill_gaps


def rename_columns(df: DataFrame) -> DataFrame:
    """Source names to internal names; other columns stay as they are."""
    return df.withColumnsRenamed(RAW_COLUMNS)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, available: {df.columns}")
    return df


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _date(df: DataFrame) -> Column:
    if _is_text(df, "date"):
        return calendar.parse_date_strict(text.null_tokens(F.col("date")))
    missing = F.raise_error(F.lit("missing date")).cast("date")
    return F.coalesce(F.col("date").cast("date"), missing)


def _amount(df: DataFrame) -> Column:
    if _is_text(df, "rainfall_mm"):
        parsed = text.parse_amount_strict(F.col("rainfall_mm"))
    else:
        parsed = F.col("rainfall_mm").cast("double")
    return numbers.nan_to_null(parsed)


def parse_readings(raw: DataFrame) -> DataFrame:
    """Standard column names and types, clean place names; nothing is filled yet.

    A malformed date or amount stops the job. Use :func:`split_rejects` first to set
    such rows aside.
    """
    df = require_columns(rename_columns(raw), "date", "state_name", "district_name", "rainfall_mm")
    return df.withColumns(
        {
            "date": _date(df),
            "rainfall_mm": _amount(df),
            "state_name": text.clean_name(text.null_tokens(F.col("state_name"))),
            "district_name": text.clean_name(text.null_tokens(F.col("district_name"))),
        }
    )


def standardise(raw: DataFrame) -> DataFrame:
    """Parsed readings with calendar parts, gaps still open."""
    return add_calendar_parts(parse_readings(raw))


def add_calendar_parts(df: DataFrame) -> DataFrame:
    month = F.month("date")
    return df.withColumns(
        {
            "year": F.year("date"),
            "month": month,
            "week_number": calendar.iso_week(F.col("date")),
            "season": calendar.assign_season(month),
        }
    )


def mark_rejects(raw: DataFrame) -> DataFrame:
    """Rows with a ``reject_reason``, NULL for those that :func:`parse_readings` accepts."""
    df = require_columns(rename_columns(raw), "date", "rainfall_mm")
    bad_date = (
        calendar.parse_date(text.null_tokens(F.col("date"))).isNull()
        if _is_text(df, "date")
        else F.col("date").isNull()
    )
    bad_amount = F.lit(False)
    if _is_text(df, "rainfall_mm"):
        token = text.null_tokens(F.col("rainfall_mm"))
        bad_amount = token.isNotNull() & text.parse_amount(F.col("rainfall_mm")).isNull()
    reason = F.when(bad_date, F.lit("date")).when(bad_amount, F.lit("rainfall_mm"))
    if SURPLUS in df.columns:
        reason = F.when(F.col(SURPLUS).isNotNull(), F.lit("fields")).otherwise(reason)
    return df.withColumn("reject_reason", reason).drop(SURPLUS)


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that :func:`parse_readings` accepts, and the others with a ``reject_reason``."""
    checked = mark_rejects(raw)
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, checked.where(F.col("reject_reason").isNotNull())


def fill_daily(
    parsed: DataFrame,
    chunk: str = "month",
    keep_raw: bool = False,
    runs: int | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """Gaps filled, no negatives, one row per input row.

    Calendar parts follow from the date, so they are added after the shuffle.

    ``chunk``, ``runs`` and ``scratch`` are as in :func:`fill_gaps`. ``keep_raw`` adds the unfilled reading as
    ``reading_mm``.
    """
    df = parsed
    if keep_raw:
        df = df.withColumn("reading_mm", F.col("rainfall_mm"))
    filled = fill_gaps(df, chunk=chunk, runs=runs, scratch=scratch)
    clean = filled.withColumn("rainfall_mm", numbers.clip_negative(F.col("rainfall_mm")))
    return add_calendar_parts(clean.drop("file_position"))


def clean_daily(
    raw: DataFrame, chunk: str = "month", keep_raw: bool = False, runs: int | None = None
) -> DataFrame:
    """The daily table: standard names, calendar parts, gaps filled, no negatives."""
    return fill_daily(parse_readings(raw), chunk, keep_raw, runs)
