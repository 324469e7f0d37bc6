import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pluvigrid.session import local_session



@pytest.fixture(scope="session")
def spark():
    session = local_session("4", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """``values(expression, inputs, type)`` evaluates a column expression on each input."""
    from pyspark.sql import functions as F

    def evaluate(expression, inputs, kind="STRING"):
        rows = spark.createDataFrame(list(enumerate(inputs)), f"i INT, x {kind}")
        result = rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
        return [row["y"] for row in result]

    return evaluate
