"""Left join of a large table to a table with one row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Copies of each dimension row.
SALTS = 4


def lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """All rows, with the dimension's columns where the key is known.

    A key may hold a large share of the rows. Adaptive execution splits such a key at
    run time, but only where both inputs come straight from a shuffle, which a grouped
    or joined dimension does not when it is already placed by the key. The salt makes
    the join shuffle it, and spreads each key over a few tasks from the start. It is
    taken from the input partition: equal rows still spread, and a repeated task
    places its rows as before.
    """
    salted_rows = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = F.explode(F.array(*(F.lit(i) for i in range(SALTS))))
    salted_dimension = dimension.where(F.col(key).isNotNull()).withColumn("__salt", copies)
    return salted_rows.join(salted_dimension, [key, "__salt"], "left").select(
        *(F.col(c) for c in rows.columns), *(F.col(c) for c in dimension.columns if c != key)
    )
