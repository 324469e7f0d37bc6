"""Daily readings derived from the test tables.

District = nation, state = region, day = ship date of the supplier's lines. The
reading is the quantity of the day's returned lines ('R'); a district day that
shipped but had no return has a row with a missing reading.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvigrid.functions.text import clean_name
from pluvigrid.session import shared_path


# Declared, so that reading a table starts no job to infer its schema.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key, district and state names."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("District"), F.col("r_name").alias("State")
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings under the source column names, one row per district and shipping day."""
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    by_nation = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_shipdate").cast("date").alias("Date"), F.col("s_nationkey").alias("n_nationkey"))
        .agg(F.sum(returned).alias("Avg_rainfall"))
    )
    return by_nation.join(places(spark, sf_dir), "n_nationkey").select("Date", "State", "District", "Avg_rainfall")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast requests, one per customer: its nation, region and a tenth of its account
    balance, so that some June totals are impossible.

    Customers of two market segments name a district or state that does not exist.
    """
    segment = F.col("c_mktsegment")
    district, state = clean_name(F.col("District")), clean_name(F.col("State"))
    return (
        table(spark, sf_dir, "customer")
        .join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("request_id"),
            F.when(segment == "MACHINERY", segment).otherwise(district).alias("district_name"),
            F.when(segment == "BUILDING", segment).otherwise(state).alias("state_name"),
            (F.col("c_acctbal") / 10).alias("june_rainfall_mm"),
        )
    )


def write_csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """The raw readings as CSV files of two header orders; early ones have no ``Note``."""
    folder = shared_path(spark, "csv-readings")
    raw = raw_readings(spark, sf_dir)
    early = F.col("Date") < "1998-07-01"
    first = raw.where(early).select("Date", "State", "District", "Avg_rainfall")
    second = raw.where(~early).select("Date", "District", "State", "Avg_rainfall", F.col("State").alias("Note"))
    first.write.csv(folder, header=True)
    second.write.mode("append").csv(folder, header=True)
    return folder
