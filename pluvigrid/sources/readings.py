"""Raw daily readings from a folder of CSV files."""

import csv
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvigrid.functions.fixed_values import SURPLUS
from pluvigrid.functions.text import null_tokens
from pluvigrid.sources.files import list_files


def require_inputs(spark: SparkSession, folder: str) -> list[str]:
    """The folder's CSV files; an error if there are none or Spark would skip one."""
    paths = list_files(spark, folder, ".csv")
    names = [path.rsplit("/", 1)[1] for path in paths]
    paths = [path for path, name in zip(paths, names) if not name.startswith(".")]
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder!r}")
    skipped = [name for name in names if name.startswith("_")]
    if skipped:
        raise ValueError(f"Spark ignores files whose name starts with '_', rename them: {skipped}")
    return paths


def _header(line: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([line.removeprefix("﻿")]), ()))


def _file_name() -> Column:
    """The file's name as it is: the metadata has it as part of a URI, where a plus stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def header_lines(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Each different first line with text, and the names of the files that begin with it.

    Executors find the lines in a scan of plain text, which opens no file on the driver; of
    the lines only the first of each file leaves its task. A file without such a line is not named.
    """
    lines = spark.read.text(paths).select(
        "value", _file_name().alias("name"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    # A file's beginning lies in one partition, where places follow its lines.
    begun = lines.where((F.col("start") == 0) & F.col("value").rlike("\\S"))
    firsts = begun.groupBy("name").agg(F.min_by("value", "place").alias("header"))
    found = firsts.groupBy("header").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return {row["header"]: row["names"] for row in found.collect()}


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack rows by column name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _scan(spark: SparkSession, header: tuple[str, ...], paths: list[str], multi_line: bool) -> DataFrame:
    if not header:
        raise ValueError(f"files without a header: {paths}")
    schema = ", ".join(f"`{name}` STRING" for name in (*header, SURPLUS))
    # The header was compared when files were grouped; one more column shows longer lines.
    rows = spark.read.csv(paths, schema=schema, header=True, quote='"', escape='"', multiLine=multi_line)
    block = F.col("_metadata.file_block_start").alias("block")
    return rows.select(
        *(null_tokens(F.col(f"`{name}`")).alias(name) for name in header),
        SURPLUS,
        _file_name().alias("source_file"),
        F.struct(block, F.monotonically_increasing_id().alias("row")).alias("file_position"),
    )


def read_daily_csv(
    spark: SparkSession, folder: str, multi_line: bool = False, keep_surplus: bool = False
) -> DataFrame:
    """All CSV files directly in ``folder``, as text columns matched by header name.

    Every spelling of a missing value becomes NULL. ``multi_line`` allows line breaks
    inside quotes, at the price of one task per file. A line with more fields than its
    header stops the job; with ``keep_surplus`` the first such field is a column for
    :func:`split_rejects`. A shorter line is padded with NULL.

    One scan over files whose headers differ in order would silently mix up columns,
    so files are grouped by header first, and each scan checks it again. Adds
    ``source_file`` and ``file_position``; the latter orders rows as in their file
    and is dropped by :func:`clean_daily`.
    """
    paths = require_inputs(spark, folder)
    by_header = defaultdict(list)
    line_of = {name: line for line, names in header_lines(spark, paths).items() for name in names}
    for path in paths:
        by_header[_header(line_of.get(path.rsplit("/", 1)[1], ""))].append(path)
    frames = [_scan(spark, header, group, multi_line) for header, group in by_header.items()]
    merged = union_by_name(*frames)
    last = ["source_file", "file_position"]
    named = [c for c in merged.columns if c not in (*last, SURPLUS)]
    if keep_surplus:
        return merged.select(*(F.col(f"`{c}`") for c in named), SURPLUS, *last)
    message = F.concat(F.lit("more fields than the header in "), F.col("source_file"))
    # In every column, so that the check holds whichever of them a query reads.
    checked = lambda c: F.when(F.col(SURPLUS).isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(f"`{c}`"))
    return merged.select(*(checked(c).alias(c) for c in named), *last)


def file_row_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("source_file").agg(F.count("*").alias("n_rows"))
