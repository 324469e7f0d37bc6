"""Reading and writing the processed tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pluvigrid.functions.fixed_values import TABLE_NAMES
from pluvigrid.operators.cleaning import require_columns
from pluvigrid.schemas import MONTHLY_REQUIRED, PROCESSED_SCHEMAS, SEASONAL_REQUIRED
from pluvigrid.sources import versions
from pluvigrid.sources.files import exists

# Queries filter the daily table by year and the seasonal one by season.
PARTITION_COLUMNS = {"daily": "year", "seasonal": "season"}
SORT_COLUMNS = {
    "daily": ("district_name", "date"),
    "monthly": ("district_name", "year", "month", "state_name"),
    "seasonal": ("district_name", "year", "state_name"),
    "probability": ("district_name", "season"),
}


def _location(folder: str, name: str, fmt: str) -> str:
    return f"{folder.rstrip('/')}/{TABLE_NAMES[name]}" + (".csv" if fmt == "csv" else "")


def write_table(
    df: DataFrame, folder: str, name: str, fmt: str = "parquet", counted: dict[str, Column] | None = None
) -> dict[str, int]:
    """Write one processed table to ``folder``, that of a new version.

    ``counted`` names aggregates that the writing job takes along, after its last shuffle, besides
    ``n_rows``; they are returned. A column ``reading_mm`` serves them and is not written. A session that
    observes a job can no longer serialise ML transformations, so pass None where it may need to.

    Partitioned tables are rebalanced by their partition column: adaptive execution
    splits large partitions and merges small ones, so no task writes a whole year
    and files come out at the advisory size; CSV files are rebalanced as they come. Rows are
    sorted inside each file, which lets Parquet skip row groups of other districts.
    """
    order = SORT_COLUMNS[name]
    if fmt == "csv":
        spread = df.hint("rebalance")
    elif name not in PARTITION_COLUMNS:
        # The hash splits rows of equal keys, however many there are.
        spread = df.repartitionByRange(*order, F.xxhash64(*df.columns))
    else:
        order = (PARTITION_COLUMNS[name], *order)
        spread = df.hint("rebalance", PARTITION_COLUMNS[name])
    rows = spread.sortWithinPartitions(*order)
    seen = Observation() if counted is not None else None
    if counted is not None:
        aggregates = {"n_rows": F.count(F.lit(1)), **counted}
        rows = rows.observe(seen, *(a.alias(n) for n, a in aggregates.items()))
    writer = rows.drop("reading_mm").write
    path = _location(folder, name, fmt)
    if fmt == "csv":
        writer.csv(path, header=True)
    elif name in PARTITION_COLUMNS:
        writer.partitionBy(PARTITION_COLUMNS[name]).parquet(path)
    else:
        writer.parquet(path)
    return dict(seen.get) if seen is not None else {}


def count_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> int:
    """Rows of a written table; of Parquet files only the footers are read."""
    return read_table(spark, folder, name, fmt).count()


def write_outputs(
    daily: DataFrame, monthly: DataFrame, seasonal: DataFrame, probability: DataFrame, folder: str, fmt: str = "parquet"
) -> dict[str, int]:
    """Write all four tables and publish them together; returns their row counts.

    Each table is computed on its own. :func:`process_readings` reads back each
    written table for the next one instead.
    """
    spark, version = daily.sparkSession, versions.staged(folder)
    tables = {"daily": daily, "monthly": monthly, "seasonal": seasonal, "probability": probability}
    for name, df in tables.items():
        write_table(df, version, name, fmt)
    counts = {name: count_table(spark, version, name, fmt) for name in tables}
    versions.publish(spark, folder, version)
    versions.prune(spark, folder)
    return counts


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One processed table as last published, with its columns in the documented order."""
    path = _location(versions.location(spark, folder), name, fmt)
    if not exists(spark, path):
        raise FileNotFoundError(f"{path!r} is missing: run process_readings first")
    if fmt == "csv":
        df = spark.read.csv(path, header=True, schema=_csv_schema(spark, path, name), enforceSchema=False)
    else:
        df = _parquet(spark, path, PROCESSED_SCHEMAS[name])
    known = [field.split()[0] for field in PROCESSED_SCHEMAS[name].split(", ")]
    first = [c for c in known if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def _parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A partitioned table without rows has no file to take the schema from."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.read.schema(schema).parquet(path)


def _csv_schema(spark: SparkSession, path: str, name: str) -> str:
    """Declared types for known columns, text for extra ones, in the file's order."""
    types = dict(field.split() for field in PROCESSED_SCHEMAS[name].split(", "))
    columns = spark.read.csv(path, header=True, inferSchema=False).columns
    return ", ".join(f"`{c}` {types.get(c, 'STRING')}" for c in columns)


def read_seasonal(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """The seasonal table; an error if it or a column the trainer needs is missing."""
    return require_columns(read_table(spark, folder, "seasonal", fmt), *SEASONAL_REQUIRED)


def read_monthly(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    return require_columns(read_table(spark, folder, "monthly", fmt), *MONTHLY_REQUIRED)


def load_processed(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The three report tables of one version, also registered as views of the same names."""
    folder = versions.location(spark, folder)
    tables = {name: read_table(spark, folder, name, fmt) for name in ("monthly", "seasonal", "probability")}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables
