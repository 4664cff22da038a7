"""Synthetic cohorts: every value is a hash of the key and a seed, so a task that runs again gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(key: str, seed: int) -> Column:
    """In (0, 1)."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(key: str, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, 2 * seed))) * F.cos(2 * 3.141592653589793 * uniform(key, 2 * seed + 1))


def cohort(ids: DataFrame, key: str, features: int = 4, subtypes: int = 3, shift: float = 2.0) -> DataFrame:
    """A row an id: age, sex, subtype and features; feature j is shifted in subtype j mod subtypes."""
    subtype = F.floor(uniform(key, 1001) * subtypes).cast("int")
    base = ids.select(key, F.round(6 + 12 * uniform(key, 1002), 1).alias("age"), F.when(uniform(key, 1003) < 0.5, "F").otherwise("M").alias("sex"), subtype.alias("subtype"))
    return base.select(*base.columns, *((normal(key, j + 1) + F.when(F.col("subtype") == j % subtypes, shift).otherwise(0.0)).alias(f"f{j}") for j in range(features)))
