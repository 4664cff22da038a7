"""Conventions shared by all operators: missing values, ranks, percentiles, multiple testing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: turn it into NULL, so that aggregates skip it."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names}) if names else df


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def null_rate(columns: list[str]) -> Column:
    """Share of a row's columns that are NULL."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns]) / F.lit(len(columns))


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def average_rank(partition: list[str], value: str, descending: bool = False) -> Column:
    """Rank from 1, ties averaged."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*partition).orderBy(order)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2


def fdr(partition: list[str], p: str, tie: str) -> Column:
    """Benjamini-Hochberg adjusted p: p * n / i over ascending p, reverse running minimum, at most 1."""
    up: WindowSpec = Window.partitionBy(*partition).orderBy(p, tie)
    raw = F.col(p) * F.count(p).over(Window.partitionBy(*partition)) / F.row_number().over(up)
    return raw


def with_fdr(df: DataFrame, partition: list[str], p: str, tie: str, out: str = "q") -> DataFrame:
    raw = df.withColumn("_raw", fdr(partition, p, tie))
    down = Window.partitionBy(*partition).orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_raw")


def zscore(partition: list[str], value: str, population: bool = True) -> Column:
    """(x - mean) / std; a std of nothing counts as one."""
    w = Window.partitionBy(*partition)
    std = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(std.isNull() | (std == 0), 1.0).otherwise(std)


def seeded(key: Column, seed: int) -> Column:
    """A deterministic number in [0, 1) for a key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))


def long_form(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row an id and feature; per-feature loops become one grouped plan."""
    typed = df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values))
    return typed.unpivot(ids, values, name, value)
