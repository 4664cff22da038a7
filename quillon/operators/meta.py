"""Pooled estimates and effect sizes from one pass of sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meta_analysis(studies: DataFrame, by: list[str], effect: str, se: str) -> DataFrame:
    """Fixed and random effects (DerSimonian-Laird) by group: n_studies, fixed_effect, fixed_se, q, i2, tau2, random_effect, ci_low, ci_high.

    Studies without a positive standard error are left out.
    """
    c = F.col
    w = studies.filter(c(se) > 0).withColumn("_w", 1 / (c(se) * c(se)))
    s = w.groupBy(*by).agg(F.count(F.lit(1)).alias("n_studies"), F.sum("_w").alias("_sw"), F.sum(c("_w") * c("_w")).alias("_sww"), F.sum(c("_w") * c(effect)).alias("_swe"), F.sum(c("_w") * c(effect) * c(effect)).alias("_swee"))
    q = F.greatest(c("_swee") - c("_swe") * c("_swe") / c("_sw"), F.lit(0.0))
    df = c("n_studies") - 1
    s = s.withColumn("fixed_effect", c("_swe") / c("_sw")).withColumn("fixed_se", 1 / F.sqrt("_sw")).withColumn("q", q)
    s = s.withColumn("i2", F.when(c("q") > 0, F.greatest((c("q") - df) / c("q"), F.lit(0.0)) * 100).otherwise(0.0))
    s = s.withColumn("tau2", F.when(df > 0, F.greatest((c("q") - df) / (c("_sw") - c("_sww") / c("_sw")), F.lit(0.0))).otherwise(0.0))
    r = w.join(s.select(*by, "tau2"), by).withColumn("_r", 1 / (1 / c("_w") + c("tau2"))).groupBy(*by).agg(F.sum("_r").alias("_rw"), F.sum(c("_r") * c(effect)).alias("_re"))
    out = s.join(r, by).withColumn("random_effect", c("_re") / c("_rw"))
    half = 1.96 / F.sqrt("_rw")
    return out.withColumn("ci_low", c("random_effect") - half).withColumn("ci_high", c("random_effect") + half).drop("_sw", "_sww", "_swe", "_swee", "_rw", "_re")


def federated_meta(sites: DataFrame, by: list[str], beta: str, se: str) -> DataFrame:
    """Inverse-variance pooling of sites; here tau2 is (Q - df) / sum of weights."""
    c = F.col
    w = sites.filter(c(se) > 0).withColumn("_w", 1 / (c(se) * c(se)))
    sw, swe = F.sum("_w"), F.sum(c("_w") * c(beta))
    q = F.greatest(F.sum(c("_w") * c(beta) * c(beta)) - swe * swe / sw, F.lit(0.0))
    return w.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sites"), (swe / sw).alias("beta"), (1 / F.sqrt(sw)).alias("se"), F.greatest((q - (F.count(F.lit(1)) - 1)) / sw, F.lit(0.0)).alias("tau2"))


def weighted_average(df: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(out))


def rubin_pool(df: DataFrame, by: list[str], estimate: str, se: str) -> DataFrame:
    """Mean of the imputations' estimates; within variance plus (1 + 1/m) times between variance."""
    return df.groupBy(*by).agg(F.avg(estimate).alias("estimate"), (F.avg(F.col(se) * F.col(se)) + (1 + 1 / F.count(F.lit(1))) * F.var_samp(estimate)).alias("variance"))


def eta_squared(df: DataFrame, label: str, value: str) -> DataFrame:
    """Between over total sum of squares, and F; negative labels are noise."""
    g = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    total = F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    k = F.count(F.lit(1))
    return g.agg((between / total).alias("eta2"), ((between / (k - 1)) / ((total - between) / (F.sum("n") - k))).alias("f"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 and Cramer's V from cell counts and marginals; empty cells count through the marginals alone."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, cb = n.groupBy("a").agg(F.sum("n").alias("ra")), n.groupBy("b").agg(F.sum("n").alias("cb"))
    t = n.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    # sum (o - e)^2 / e = sum o^2 / e - t, so that only cells with rows are needed
    full = n.join(ra, "a").join(cb, "b").crossJoin(F.broadcast(t))
    chi = F.sum(F.col("n") * F.col("n") * F.col("t") / (F.col("ra") * F.col("cb"))) - F.first("t")
    return full.agg(chi.alias("chi2"), F.first("t").alias("t"), F.first("ka").alias("ka"), F.first("kb").alias("kb")).select("chi2", F.sqrt(F.col("chi2") / (F.col("t") * F.least(F.col("ka") - 1, F.col("kb") - 1))).alias("v"))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error over equal bins, and the Brier score."""
    b = df.withColumn("_b", F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)))
    g = b.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sq"))
    gap = F.abs(F.col("mp") - F.col("my"))
    return g.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum("sq") / F.sum("n")).alias("brier"))
