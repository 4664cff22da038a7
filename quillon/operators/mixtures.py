"""Exposure mixtures, critical periods and specificity as grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(long: DataFrame, feature: str, value: str) -> DataFrame:
    """(feature, value, q): average rank by n + 1, one row a distinct value. Rows are counted by value first, so a window holds distinct values only."""
    n = long.filter(F.col(value).isNotNull()).groupBy(feature, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(feature)
    upto = F.sum("k").over(w.orderBy(value))
    return n.select(feature, value, ((upto - (F.col("k") - 1) / 2) / (F.sum("k").over(w) + 1)).alias("q"))


def quantile_mixture(df: DataFrame, features: list[str], outcome: str, subsets: list[Column]) -> DataFrame:
    """Weighted quantile sum: feature, weight, effect, r.

    A feature's weight is the mean over the subsets of its share of the absolute
    correlations with the outcome; all subsets are one aggregate. The effect is the
    slope of the outcome on the weighted sum of quantiles. Rows that lack a feature
    or the outcome are left out.
    """
    df = df.dropna(subset=[*features, outcome]).select(*df.columns, F.col(outcome).cast("double").alias("y_"))
    ranks = average_ranks(df.select(F.explode(F.create_map(*(x for c in features for x in (F.lit(c), F.col(c).cast("double"))))).alias("feature", "v")), "feature", "v")
    for i, c in enumerate(features):
        mine = ranks.filter(F.col("feature") == c).select(F.col("v").alias(f"v{i}_"), F.col("q").alias(f"q{i}_"))
        df = df.join(mine, F.col(c).cast("double") == F.col(f"v{i}_")).drop(f"v{i}_")
    each = [F.struct(F.lit(c).alias("feature"), *(F.abs(F.corr(F.when(s, F.col(f"q{i}_")), F.when(s, F.col("y_")))).alias(f"c{b}") for b, s in enumerate(subsets))) for i, c in enumerate(features)]
    totals = df.agg(F.array(*each).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    # One row a feature: these windows hold len(features) rows.
    share = sum((F.col(f"c{b}") / F.sum(f"c{b}").over(Window.partitionBy()) for b in range(len(subsets))), F.lit(0.0)) / len(subsets)
    weights = totals.select("feature", share.alias("weight"))
    wide = weights.groupBy().pivot("feature", features).agg(F.first("weight"))
    x = sum((F.col(f"q{i}_") * F.col(f"`{c}__w`") for i, c in enumerate(features)), F.lit(0.0))
    scored = df.crossJoin(F.broadcast(wide.toDF(*(f"{c}__w" for c in features)))).select("y_", x.alias("x_"))
    fit = scored.agg((F.covar_pop("y_", "x_") / F.var_pop("x_")).alias("effect"), F.corr("y_", "x_").alias("r"))
    return weights.crossJoin(F.broadcast(fit))


def critical_periods(df: DataFrame, period: str, exposure: str, outcome: str) -> DataFrame:
    """Slope of the outcome on each period's exposure, with the t of its correlation in place of a permutation's p; the largest slope is strongest."""
    s = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(outcome, exposure).alias("effect"), F.corr(outcome, exposure).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    # One row a period, so that the window is small.
    return s.select(period, "n", "effect", t.alias("t"), (F.abs("effect") == F.max(F.abs("effect")).over(Window.partitionBy())).alias("strongest"))


def specificity(df: DataFrame, keys: list[str], effect: str, expected: Column) -> DataFrame:
    """Mean absolute effect inside expected regions by its sum with that outside; null where either is missing."""
    a, b = F.avg(F.when(expected, F.abs(effect))), F.avg(F.when(~expected, F.abs(effect)))
    m = df.groupBy(*keys).agg(a.alias("a_"), b.alias("b_"))
    return m.select(*keys, F.when(F.col("a_") + F.col("b_") > 0, F.col("a_") / (F.col("a_") + F.col("b_"))).when(F.col("a_").isNotNull() & F.col("b_").isNotNull(), 0.0).alias("specificity"))
