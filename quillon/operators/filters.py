"""Row and column filters of quality control."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import semantics as S


def rows_with_few_missing(df: DataFrame, columns: list[str], most: float) -> DataFrame:
    return df.filter(S.null_rate(columns) < most)


def columns_with_few_missing(df: DataFrame, columns: list[str], most: float) -> list[str]:
    """Names of columns whose missing rate is under `most`: one aggregate, one row to the driver."""
    rates = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).first()
    return [c for c in columns if rates[c] is not None and rates[c] < most]


def missingness_filter(df: DataFrame, keys: list[str], columns: list[str], row_most: float, column_most: float) -> DataFrame:
    """Rows first, then columns judged on the rows that are left."""
    rows = rows_with_few_missing(df, columns, row_most)
    return rows.select(*keys, *columns_with_few_missing(rows, columns, column_most))


def drop_outlier_rows(df: DataFrame, columns: list[str], z_most: float, share_most: float) -> DataFrame:
    """Drop rows with over share_most of the columns at |z| over z_most. A missing or undefined z is no outlier.

    The moments are one small row, cross-joined by broadcast, so that the rows are not shuffled.
    """
    moments = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(moments))
    flags = [F.coalesce((F.abs((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) > z_most).cast("int"), F.lit(0)) for c in columns]
    return out.filter(reduce(lambda a, b: a + b, flags) / len(columns) <= share_most).select(*df.columns)


def depth_and_prevalence(long: DataFrame, sample: str, feature: str, count: str, least_depth: float, least_prevalence: float) -> DataFrame:
    """Long (sample, feature, count): samples of enough depth, then features seen in enough of those."""
    deep = long.groupBy(sample).agg(F.sum(count).alias("_d")).filter(F.col("_d") >= least_depth).select(sample)
    left = long.join(deep, sample, "left_semi")
    n = deep.agg(F.count(F.lit(1)).alias("_n"))
    seen = left.groupBy(feature).agg(F.count_distinct(F.when(F.col(count) > 0, F.col(sample))).alias("_k")).crossJoin(F.broadcast(n))
    return left.join(seen.filter(F.col("_k") / F.col("_n") >= least_prevalence).select(feature), feature, "left_semi")


def qc_metrics(df: DataFrame, key: str, columns: list[str], z_most: float = 5.0) -> DataFrame:
    """One row: n_samples, missing_rate, n_duplicates, n_outliers (rows with any |z| over z_most)."""
    kept = drop_outlier_rows(df, columns, z_most, 0.0)
    base = df.agg(F.count(F.lit(1)).alias("n_samples"), F.avg(S.null_rate(columns)).alias("missing_rate"), (F.count(key) - F.count_distinct(key)).alias("n_duplicates"))
    return base.crossJoin(kept.agg(F.count(F.lit(1)).alias("_k"))).withColumn("n_outliers", F.col("n_samples") - F.col("_k")).drop("_k")


def contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row a rule with the number of rows that break it; one pass over the data."""
    one = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return one.unpivot([], list(rules), "rule", "violations").withColumn("valid", F.col("violations") == 0)


def search(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of optional equality predicates; None asks nothing."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), [(k, v) for k, v in wanted.items() if v is not None], df)


def drop_constant_columns(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Fill missing values, then drop columns without variance."""
    full = df.fillna(fill, columns)
    spread = full.agg(*((F.max(c) != F.min(c)).alias(c) for c in columns)).first()
    return full.drop(*(c for c in columns if not spread[c]))


def prevalence(long: DataFrame, entity: str, feature: str, value: str, least_features: int, least_entities: int) -> DataFrame:
    """Entities and features with enough positive values, both counted on the unfiltered table."""
    positive = long.filter(F.col(value) > 0)
    rows = positive.groupBy(entity).agg(F.count_distinct(feature).alias("_n")).filter(F.col("_n") >= least_features)
    cols = positive.groupBy(feature).agg(F.count_distinct(entity).alias("_n")).filter(F.col("_n") >= least_entities)
    return long.join(rows.select(entity), entity, "left_semi").join(cols.select(feature), feature, "left_semi")
