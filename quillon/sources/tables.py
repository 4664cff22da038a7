"""Readers of the standard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, where: Column | str | None = None) -> DataFrame:
    """`name` of a data folder; NaN in floating columns becomes NULL (NaN means missing).

    `where` keeps the rows for which it holds. It is tested on the file's own columns, so that comparisons with floating
    columns reach the scan, and again once NaN is NULL: NaN counts as larger than every number there, so a row may pass the
    first test only. Tests for NULL of floating columns belong in a later filter(), since NaN isn't NULL in the file.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    df = df.withColumns({c: F.nanvl(c, F.lit(None)) for c in floats})
    return df if where is None else df.filter(where)
