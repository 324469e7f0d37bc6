"""Global order without a single-task sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvigrid.session import cut_lineage

RUN_BYTES = 256 << 20


def runs_for(input_bytes: int, run_bytes: int = RUN_BYTES) -> int:
    """How many runs of ``run_bytes`` an input of known size needs."""
    return max(1, -(-input_bytes // run_bytes))


def range_chunks(df: DataFrame, keys: list[str], runs: int, chunk: str = "__chunk") -> DataFrame:
    """Split into about ``runs`` equal runs of the global order; ``chunk`` numbers them.

    Range boundaries are sampled from the rows, so a hot key is spread over as many
    runs as its share of the rows. The result is stored: a run number must not
    change when a lost executor's work is repeated.
    """
    spread = df.repartitionByRange(runs, *keys).withColumn(chunk, F.spark_partition_id())
    return cut_lineage(spread)


def label_codes(df: DataFrame, name: str, code: str) -> DataFrame:
    """Codes 0..n-1 of the distinct values of ``name`` in sorted order."""
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = range_chunks(names, [name], parts)
    # One row per run, so never more rows than shuffle partitions.
    runs = Window.partitionBy(F.lit(0)).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy("__chunk")
        .count()
        .select("__chunk", F.coalesce(F.sum("count").over(runs), F.lit(0)).alias("__offset"))
    )
    inside = F.row_number().over(Window.partitionBy("__chunk").orderBy(name))
    return (
        chunked.withColumn("__rank", inside)
        .join(F.broadcast(offsets), "__chunk")
        .select(name, (F.col("__offset") + F.col("__rank") - 1).cast("int").alias(code))
    )
