"""Connected components of a distributed link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.plans.runtime import cut


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of ``links`` (a, b): the class is the least node of its component.

    Every round replaces links by links to the least neighbour. Minima are aggregated
    partially; the join that hands a minimum back to a node's links is by the node, and
    adaptive execution splits the links of a node that has very many. Links stay on the executors; the driver sees a count and a checksum for each round.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
        seen = state
