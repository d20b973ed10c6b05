"""Connected groups of records, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import cut


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, group_id) for every node of the edges; group_id is the smallest node of the group.

    Each round links every node's larger neighbours to its smallest neighbour (large star), then its smaller
    ones (small star); the graph ends as one star a group after a logarithmic number of rounds. Nulls and
    loops are ignored; an empty table gives an empty result. Rows are one per edge, so no group is gathered.
    """
    e = cut(edges.select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi")).filter("lo <> hi").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        down = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = (
            large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(down, "u")
            .select(F.explode(F.array(F.struct("m", F.col("v").alias("x")), F.struct("m", F.col("u").alias("x")))).alias("p"))
            .select(F.col("p.m").alias("lo"), F.col("p.x").alias("hi")).filter("lo <> hi").distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("group_id")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("group_id")).distinct())
