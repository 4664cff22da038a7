"""Average ranks of any number of rows, and rank correlations between two sets of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.sources.shared import stored


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the rank of `value` within `by`, from 1, ties averaged; NULL for a null or NaN value, which takes no rank.

    Distinct values are counted and sorted by ranges; a rank is what earlier ranges hold plus what comes before in its own, so
    no task sorts a whole group. Rows of a null key make a group of their own.
    """
    real = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = df.select(*by, real.alias("_value")).filter("_value is not null").groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counts.repartitionByRange(parts, *by, "_value").withColumn("_part", F.spark_partition_id()))
    held = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_held"))  # a row a group and range
    before = held.withColumn("_before", F.coalesce(F.sum("_held").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_held")
    upto = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    local = dealt.withColumn("_upto", upto)
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    ranked = local.join(before, same(local, before, [*by, "_part"])).select(*(local[k].alias(f"_by{i}") for i, k in enumerate(by)), local["_value"].alias("_at"), (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    rows = df.withColumn("_value", real)
    match = [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(by)]
    return rows.join(ranked, [*match, F.col("_value") == F.col("_at")], "left").select(*df.columns, out)


def cross_edges(left: DataFrame, right: DataFrame, entity: str, feature: str, value: str, method: str = "spearman", least: int = 10, strength: float = 0.3, alpha: float = 0.05) -> DataFrame:
    """(source, target, r, n, p) of the pairs of a feature of `left` and one of `right` (both entity, feature, value) that
    correlate by at least `strength` with p under alpha, from at least `least` entities that have both values. Ranks are
    taken among these entities. Repeated rows of an entity and feature count each; constant features make no edge.

    Both sides are stored first: ranks are looked up by value, and sums of doubles may differ from one evaluation to the next."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown correlation {method}")
    side = lambda d, f, v: stored(d.select(entity, F.col(feature).alias(f), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias(v)).dropna())
    both = side(left, "source", "x").join(side(right, "target", "y"), entity)
    if method == "spearman":
        both = average_ranks(average_ranks(both, ["source", "target"], "x", "rx"), ["source", "target"], "y", "ry").select("source", "target", F.col("rx").alias("x"), F.col("ry").alias("y"))
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))  # NULL for a constant
    c = both.groupBy("source", "target").agg(r.alias("r"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.abs("r") >= strength))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return c.withColumn("p", special.t_p(t, (F.col("n") - 2).cast("double"))).filter(F.col("p") < alpha)
