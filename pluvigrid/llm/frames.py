"""Small helpers for operators whose per-row work is Python inside Arrow batches."""

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvigrid.session import shared_path, stored, working_path, working_tables

__all__ = [
    "ddl", "importable", "map_arrow", "map_batches", "shared_path", "stored", "text_column", "texts_as_bytes", "texts_as_str",
    "working_path", "working_tables",
]

SLICE = 1_000  # rows that Python works on at once


def importable(spark: SparkSession) -> None:
    """Lets the workers of a local session find this package where the driver did.

    On a cluster the package is installed or shipped with the job.
    """
    context = spark.sparkContext
    if context.master.startswith("local["):
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with functions of this package."""
    importable(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE
) -> DataFrame:
    """``function`` on slices of the Arrow batches of ``df``, so that Python holds few texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = function(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    return map_arrow(df, run, schema)


def texts_as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts without decoding; null is empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def texts_as_str(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def text_column(name: str = "text"):
    """The column as string, so that a column of nulls without a type works too."""
    return F.col(name).cast("string").alias(name)


def ddl(df: DataFrame, *columns: str) -> str:
    """Schema text of ``df`` or of some of its columns."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns or df.columns)
