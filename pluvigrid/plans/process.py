"""Raw CSV folder to the four processed tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvigrid.operators.cleaning import fill_daily, mark_rejects, parse_readings
from pluvigrid.operators.departure import (
    above_normal_probability,
    flag_above_normal,
    monthly_departure,
    seasonal_departure,
)
from pluvigrid.operators.ordering import runs_for
from pluvigrid.operators.quality import coverage_summary
from pluvigrid.operators.rollup import monthly_units, rounded_totals, seasonal_units
from pluvigrid.session import own_session, shared_path, stored
from pluvigrid.sources import versions
from pluvigrid.sources.files import remove, size_of
from pluvigrid.sources.processed import read_table, write_table
from pluvigrid.sources.readings import read_daily_csv


@dataclass(frozen=True)
class Summary:
    """What a run wrote, set aside and found."""

    rows: dict[str, int]  # per table
    rejected: int
    missing_before: int
    missing_after: int
    coverage: dict  # first and last date, numbers of districts, states and years


def process_readings(
    spark: SparkSession,
    raw_folder: str,
    out_folder: str,
    fmt: str = "parquet",
    chunk: str = "month",
    quarantine_folder: str | None = None,
    multi_line: bool = False,
) -> Summary:
    """Clean, fill, roll up, compare with the LPA, and write.

    With ``quarantine_folder``, rows with a malformed date or amount or with surplus
    fields go there; without it they stop the job. The files are read once either way.
    ``multi_line`` is as in :func:`read_daily_csv`, the rest as in :func:`process_frame`.
    """
    raw = read_daily_csv(spark, raw_folder, multi_line, keep_surplus=quarantine_folder is not None)
    if quarantine_folder is None:
        return process_frame(raw, out_folder, fmt, chunk)
    marked = shared_path(spark, "marked-readings")
    try:
        rows = stored(mark_rejects(raw), "marked-readings", marked)
        reason = F.col("reject_reason")
        bad = rows.where(reason.isNotNull()).drop("file_position")
        bad.write.mode("overwrite").parquet(quarantine_folder)
        rejected = bad.count()
        good = rows.where(reason.isNull()).drop("reject_reason")
        return process_frame(good, out_folder, fmt, chunk, rejected)
    finally:
        remove(spark, marked)


def process_frame(
    raw: DataFrame,
    out_folder: str,
    fmt: str = "parquet",
    chunk: str = "month",
    rejected: int = 0,
) -> Summary:
    """The same from a frame of raw readings.

    Parsed rows are written as columns to the shared folder first. After that every
    stage reads the table the stage before it wrote; a lost executor never sends the job
    back to the raw files. With ``chunk="range"`` the number of runs follows from the size
    of the parsed rows. Months are summed once, exactly, and seasons from them: totals do not depend
    on the layout of the rows.

    Rows and missing readings are counted by the jobs that write them. All tables become
    readable together when the last one is written; a job that fails before leaves the old ones.
    """
    spark = raw.sparkSession
    own = own_session(spark)
    scratch = {name: shared_path(spark, name) for name in ("parsed-readings", "neighbours", "month-units")}
    version = versions.staged(out_folder)
    missing = lambda c: F.count(F.when(F.col(c).isNull(), 1))
    try:
        parsed = parse_readings(raw)
        stored(parsed, "parsed-readings", scratch["parsed-readings"])
        readings = own.read.schema(parsed.schema).parquet(scratch["parsed-readings"])
        runs = runs_for(size_of(spark, scratch["parsed-readings"])) if chunk == "range" else None
        daily = fill_daily(readings, chunk, keep_raw=True, runs=runs, scratch=scratch["neighbours"])
        counts = {"missing_before": missing("reading_mm"), "missing_after": missing("rainfall_mm")}
        seen = {"daily": write_table(daily, version, "daily", fmt, counts)}
        days = read_table(own, version, "daily", fmt)
        coverage = coverage_summary(days).first().asDict()
        months = stored(monthly_units(days), "month-units", scratch["month-units"])
        seen["monthly"] = write_table(monthly_departure(rounded_totals(months)), version, "monthly", fmt, {})
        seasons = rounded_totals(seasonal_units(months))
        seen["seasonal"] = write_table(flag_above_normal(seasonal_departure(seasons)), version, "seasonal", fmt, {})
        odds = above_normal_probability(read_table(own, version, "seasonal", fmt))
        seen["probability"] = write_table(odds, version, "probability", fmt, {})
    finally:
        for path in scratch.values():
            remove(spark, path)
    versions.publish(spark, out_folder, version)
    versions.prune(spark, out_folder)
    rows = {name: found["n_rows"] for name, found in seen.items()}
    return Summary(rows, rejected, seen["daily"]["missing_before"], seen["daily"]["missing_after"], coverage)


def output_row_counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Row counts of the written tables as a frame."""
    return spark.createDataFrame(list(counts.items()), "table_name STRING, n_rows BIGINT").select(
        F.col("table_name"), F.col("n_rows")
    )
