"""Connected components of a table of links, by alternating large and small stars.

After Kiveris et al., Connected components in MapReduce and beyond (2014). Links stay
distributed; each round is two aggregations by node, combined before their shuffles, and two
plain joins, which adaptive execution splits at a hot node. Each round's links are written
to the shared folder, so lineage does not grow.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """Links from the neighbours of each node (only the smaller, or only the larger) to its least neighbour."""
    if smaller:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        rest = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # A larger neighbour moves to the least; links (larger, node) hold each of them once.
    larger = links.select(F.col("v").alias("node"), F.col("u").alias("larger"))
    return (
        larger.join(least.withColumnRenamed("u", "node"), "node")
        .select(F.col("larger").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``u``, ``v`` long): the least node reachable."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = frames.stored(links, "links")
    state = None
    while True:
        # Links point from larger to smaller node. When a round changes nothing, they are stars.
        links = frames.stored(_star(_star(links, smaller=False), smaller=True), "links")
        digest = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if digest == state:
            break
        state = digest
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
