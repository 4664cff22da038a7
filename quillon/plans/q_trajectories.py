"""Trajectories over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import warping as W
from quillon.registry import query
from quillon.sources.tables import table


@query("M21_temporal_clusters")
def temporal(spark, sf):
    """Customers by the shape of their year: what all their orders of each month are worth."""
    o = table(spark, sf, "orders")
    months = o.groupBy("o_custkey").agg(*(F.coalesce(F.sum(F.when(F.month("o_orderdate") == m, F.col("o_totalprice"))), F.lit(0.0)).alias(f"m{m}") for m in range(1, 13)))
    series = months.select("o_custkey", F.array(*(f"m{m}" for m in range(1, 13))).alias("x"))
    return W.TrajectoryClusters(series, "o_custkey", "x", 12, k=4, band=2, rounds=4).assigned()
