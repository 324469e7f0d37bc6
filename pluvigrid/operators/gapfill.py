"""Filling missing readings inside each district's series.

One window over a whole series would put a hot district into one task. Series are
cut into chunks instead. One shuffle and one sort place each chunk's rows; the
position of every row and the readings next to it inside its chunk are stored. A
table of chunk edges, a few numbers per chunk from one pass over what was stored,
then carries readings across chunk borders, to the rows that need one.

Neighbours are found with ``lag``/``lead ... IGNORE NULLS``, which is one pass and
one sort. A frame up to "unbounded following" would rescan the chunk for every row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvigrid.operators.ordering import range_chunks
from pluvigrid.session import stored

SERIES = "district_name"
# Orders rows of one day; only the columns that are present are used.
TIE_COLUMNS = ("source_file", "file_position", "state_name")
CALENDAR_CHUNKS = ("year", "month", "day")


def reading_order(df: DataFrame, value: str = "rainfall_mm") -> list[str]:
    """By day, then place in the files, state and value: equal rows alone are left in any order."""
    return ["date", *(c for c in TIE_COLUMNS if c in df.columns), value]


def fill_gaps(
    df: DataFrame,
    value: str = "rainfall_mm",
    chunk: str = "month",
    edges: str = "both",
    runs: int | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """Linear fill by row position, then the nearest reading at the ends of a series.

    ``chunk`` is ``year``, ``month`` or ``day`` of ``date``, or ``range`` for ``runs`` runs of
    equal size whatever the skew: for series with very many readings a day.
    ``edges="trailing"`` leaves readings before the first valid one missing. Rows without a
    district get NULL and are not shuffled; a series without any reading stays NULL.
    The result reads a table written to ``scratch``, a fresh shared path if not given.
    """
    if edges not in ("both", "trailing"):
        raise ValueError(f"unknown edges {edges!r}")
    order = reading_order(df, value)
    columns = df.columns
    named = df.where(F.col(SERIES).isNotNull())
    if chunk == "range":
        if runs is None:
            raise ValueError("chunk='range' needs the number of runs")
        chunked = range_chunks(named, [SERIES, *order], runs)
    elif chunk in CALENDAR_CHUNKS:
        chunked = named.withColumn("__chunk", F.col("date") if chunk == "day" else F.trunc("date", chunk))
    else:
        raise ValueError(f"unknown chunk {chunk!r}")

    local = stored(_neighbours(chunked, value, order), "neighbours", scratch)
    known, inside = F.col(value).isNotNull(), F.col("__before").isNotNull() & F.col("__after").isNotNull()
    settled = local.where(known | inside)
    open_ended = local.where(~known & ~inside).join(_carried_readings(local, value), [SERIES, "__chunk"], "left")
    line = lambda before, after: _interpolated(F.col(value), F.col("__row"), before, after, edges == "both")
    carried = open_ended.withColumn(
        value, line(F.coalesce("__before", "__carry_before"), F.coalesce("__after", "__carry_after"))
    )
    filled = settled.withColumn(value, line(F.col("__before"), F.col("__after")))
    nameless = df.where(F.col(SERIES).isNull()).withColumn(value, F.lit(None).cast(df.schema[value].dataType))
    return filled.select(*columns).unionByName(carried.select(*columns)).unionByName(nameless)


def _over(partition: list[str], order: list[str]) -> str:
    quote = lambda names: ", ".join(f"`{name}`" for name in names)
    return f"OVER (PARTITION BY {quote(partition)} ORDER BY {quote(order)})"


def _neighbours(chunked: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Each row's position in its chunk, and the nearest readings before and after it there."""
    inside = Window.partitionBy(SERIES, "__chunk").orderBy(*order)
    numbered = chunked.withColumn("__row", F.row_number().over(inside)).withColumn(
        "__known", F.when(F.col(value).isNotNull(), F.struct(F.col("__row").alias("k"), F.col(value).alias("v")))
    )
    # Rows are numbered once and ordered by that number from here on.
    inside_sql = _over([SERIES, "__chunk"], ["__row"])
    return (
        numbered.withColumn("__before", F.expr(f"lag(__known) IGNORE NULLS {inside_sql}"))
        .withColumn("__after", F.expr(f"lead(__known) IGNORE NULLS {inside_sql}"))
        .drop("__known")
    )


def _carried_readings(local: DataFrame, value: str) -> DataFrame:
    """Nearest readings outside each chunk, at positions counted from the chunk's start.

    Only chunks that begin or end with a missing reading are kept. A series has one
    row per chunk here: its months or days, or at most one per run.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__row").alias("k"), F.col(value).alias("v")))
    chunks = local.groupBy(SERIES, "__chunk").agg(
        F.count("*").alias("__n"), F.min(known).alias("__first"), F.max(known).alias("__last")
    )
    earlier = Window.partitionBy(SERIES).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    for edge in ("__first", "__last"):
        placed = placed.withColumn(edge, _shifted(F.col(edge), F.col("__offset")))
    across = _over([SERIES], ["__chunk"])
    carried = placed.withColumn("__prev", F.expr(f"lag(__last) IGNORE NULLS {across}")).withColumn(
        "__next", F.expr(f"lead(__first) IGNORE NULLS {across}")
    )
    start, end = F.col("__offset") + 1, F.col("__offset") + F.col("__n")
    open_ended = F.col("__first").isNull() | (F.col("__first.k") > start) | (F.col("__last.k") < end)
    return carried.where(open_ended).select(
        SERIES,
        "__chunk",
        _shifted(F.col("__prev"), -F.col("__offset")).alias("__carry_before"),
        _shifted(F.col("__next"), -F.col("__offset")).alias("__carry_after"),
    )


def _shifted(reading: Column, by: Column) -> Column:
    moved = F.struct((reading["k"] + by).alias("k"), reading["v"].alias("v"))
    return F.when(reading.isNotNull(), moved)


def _interpolated(value: Column, row: Column, before: Column, after: Column, fill_leading: bool) -> Column:
    """The order of operations is part of the result: doubles are not associative."""
    slope = (after["v"] - before["v"]) / (after["k"] - before["k"])
    line = slope * (row - before["k"]) + before["v"]
    ends = [before["v"], after["v"]] if fill_leading else [before["v"]]
    return F.coalesce(value, line, *ends)
