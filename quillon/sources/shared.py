"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where there is one machine (master local) and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="quillon-core-"))
        atexit.register(_LOCAL[0].cleanup)
    return _LOCAL[0].name


def _hadoop(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and lost executors lose nothing.

    The table goes when the application ends, or earlier by dropped().
    """
    spark = df.sparkSession
    name = f"{folder(spark)}/core-{uuid.uuid4().hex}"
    store, path = _hadoop(spark, name)
    store.deleteOnExit(path)
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # else shuffles stay until the driver collects its garbage
    before = spark.conf.get(freed, None)
    spark.conf.set(freed, "true")
    try:
        df.write.parquet(name)
    finally:
        spark.conf.unset(freed) if before is None else spark.conf.set(freed, before)
    out = spark.read.schema(df.schema).parquet(name)
    out._stored_at = name
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        if name := t.__dict__.pop("_stored_at", None):
            store, path = _hadoop(t.sparkSession, name)
            store.delete(path, True)
