"""Shards of equal row counts whose rows are near in several metadata dimensions.

Method: Hilbert-curve ordering. Each dimension is quantised at its quantiles; rows are sorted
by the index of their cell on the Hilbert curve (ties: by id, checksum and size), and the
order is cut into runs. Files of one run then cover small ranges of every dimension, so
readers can prune on any of them. Row counts of shards differ by one at most (law ``rows``).

Numbers are quantised by value, all else by the place of the whole value, however long, among the
values of all rows in the order of their UTF-8 bytes; nulls are the lowest. The order is found by a range partitioning, which spreads a hot cell over several tasks; a run's
place in the whole comes from one count per partition. Repeated rows take places of their
own, next to each other. With fewer rows than shards some shards are empty; an empty table
gives no row. Columns named like a result are replaced.
"""

from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvigrid.llm import frames

SHARDS = 16
BITS = 5  # per dimension
DIMENSIONS = ("lang", "source", "n_chars")
QUANTILE_ACCURACY = 10_000


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates below ``2**bits``.

    After J. Skilling, Programming the Hilbert curve (2004): undo the reflections and
    exchanges of each level, Gray-decode, and interleave the bits.
    """
    x = np.array(cells, np.int64).T.copy()
    if not len(x):
        return np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for axis in x:
            up = (axis & high) > 0
            swap = np.where(up, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(up, low, swap)
            axis ^= np.where(up, 0, swap)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            index = index << 1 | (axis >> level & 1)
    return index


def _text_cuts(df: DataFrame, column: str, steps: int) -> list[str]:
    """The values at ``1 / steps``, ``2 / steps`` and so on of all rows, in the order of the values.

    Rows are counted by value first, so a hot value is one row. Counts are added up within range
    partitions of the values and over one sum per partition.
    """
    value = F.col(column).cast("string").alias("value")
    counts = df.select(value).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = frames.stored(
        counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "values"
    )
    sizes = placed.groupBy("part").agg(F.sum("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    rows = sizes.agg(F.sum("size")).first()[0]
    if not rows:
        return []
    end = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    ends = placed.join(F.broadcast(starts), "part").select("value", "n", end.alias("end"))
    passed = ends.selectExpr("value", f"((end - n) * {steps}) div {rows} AS first", f"(end * {steps}) div {rows} AS last")
    # At most ``steps`` rows.
    found = passed.where("first < last").orderBy("last").collect()
    return [r["value"] for r in found for _ in range(r["first"], min(r["last"], steps - 1))]


def cells(df: DataFrame, dimensions=DIMENSIONS, bits: int = BITS) -> list[Column]:
    """Per dimension, how many of its cut points lie below the row's value; they are quantiles of all rows."""
    steps = 1 << bits
    shares = F.array(*(F.lit(i / steps) for i in range(1, steps)))
    numbers = [d for d in dimensions if isinstance(df.schema[d].dataType, T.NumericType)]
    cuts = {d: _text_cuts(df, d, steps) for d in dimensions if d not in numbers}
    if numbers:
        found = df.agg(*(F.percentile_approx(F.col(d).cast("double"), shares, QUANTILE_ACCURACY) for d in numbers)).first()
        cuts |= dict(zip(numbers, found))
    kinds = {d: "double" if d in numbers else "string" for d in dimensions}
    return [
        sum((F.coalesce((F.col(d).cast(kinds[d]) > cut).cast("int"), F.lit(0)) for cut in cuts[d] or []), F.lit(0))
        for d in dimensions
    ]


def curve(df: DataFrame, dimensions=DIMENSIONS, bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with each row's place on the curve."""
    placed = [cell.alias(f"__c{i}") for i, cell in enumerate(cells(df, dimensions, bits))]
    kept = [c for c in df.columns if c != name]

    def run(batch):
        coordinates = np.stack([batch.column(f"__c{i}").to_numpy() for i in range(len(dimensions))], axis=1)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(hilbert_index(coordinates, bits), pa.int64())], names=[*kept, name]
        )

    return frames.map_batches(df.select(*kept, *placed), run, f"{frames.ddl(df, *kept)}, `{name}` long")


def shards(df: DataFrame, order: list[str], count: int = SHARDS, parts: int | None = None) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: runs of the order, of row counts at most one apart.

    ``parts`` range partitions do the sorting (the session's shuffle partitions if not given);
    what is sorted is written to the shared folder.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    ordered = df.select(*kept).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches):
        part, place = TaskContext.get().partitionId(), counter()
        for batch in batches:
            n = batch.num_rows
            places = pa.array([next(place) for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int32()), places], names=[*kept, "__part", "__place"]
            )

    numbered = frames.stored(
        frames.map_arrow(ordered, number, f"{frames.ddl(df, *kept)}, __part int, __place long"), "ordered"
    )
    # One row per range partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    rows = numbered.count()
    rank = F.col("__start") + F.col("__place")
    shard = F.expr(f"((__start + __place) * {count}) div {max(rows, 1)}")
    first = F.expr(f"(__shard * {rows} + {count - 1}) div {count}")
    return (
        numbered.join(F.broadcast(starts), "__part")
        .withColumn("__shard", shard)
        .select(*kept, F.col("__shard").cast("int").alias("shard"), (rank - first).alias("slot"))
    )


def assignment(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per document."""
    dimensions = [d for d in DIMENSIONS if d in docs.columns]
    text = frames.text_column()
    slim = docs.select(
        "doc_id", *dimensions,
        F.coalesce(F.octet_length(text) + 1, F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shards(curve(slim, dimensions), ["curve", "doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
