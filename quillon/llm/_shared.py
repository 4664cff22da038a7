"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only on one machine (master local), as in tests, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        made = tempfile.TemporaryDirectory(prefix="quillon-")
        atexit.register(made.cleanup)
        _OWN["dir"] = made.name
    return _OWN["dir"]


def fresh(columns: list[str], name: str) -> str:
    """name, or name with underscores after it, so that it isn't one of columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after limiting the session's Arrow batches to so many rows: texts may be long, and a batch is held
    several times between Spark and Python. A smaller limit that is already set stays. The limit outlives the
    call, since plans read it when they run."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The table goes when the application ends, or earlier by release().
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    store, path = _path(spark, name)
    store.deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(name)
    out = spark.read.schema(df.schema).parquet(name)
    out._quillon_table = name
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for t in tables:
        if name := t.__dict__.pop("_quillon_table", None):
            store, path = _path(t.sparkSession, name)
            store.delete(path, True)
