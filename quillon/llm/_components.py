"""Connected components of an edge table, without a driver or a single task holding them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the edges (a, b).

    Alternates large-star and small-star contraction (Kiveris et al. 2014), each a
    minimum a node and a join, until the edges are stars; the rounds grow with the
    logarithm of the components' size. Every round's edges are written to the shared
    folder, so that lineage stays short.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct())
    before = None
    while True:
        both = now.unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        down = large.filter("hi <> lo").distinct()
        low = down.groupBy("hi").agg(F.min("lo").alias("m"))
        small = down.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        earlier, now = now, materialise(small.filter("hi <> lo").distinct())
        release(earlier)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            break
        before = state
    return now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node").unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
