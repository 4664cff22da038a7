"""Structured Streaming forms of the polling behaviour: change detection, dedupe, windows, sessions, digests.

Each takes a streaming (or batch) DataFrame and returns one; the caller starts the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(stream: DataFrame, key: str, content: str, time: str, delay: str = "7 days") -> DataFrame:
    """Rows whose content hash differs from the key's last one: (key, hash, first_seen). State: one hash a key, dropped after `delay` without news."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    hashed = stream.select(F.col(key).cast("string").alias("key"), F.sha2(content, 256).alias("hash"), F.col(time).alias("time"))

    def follow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.getOption, []
        last = last[0] if last else None
        rows = pd.concat(list(batches)).sort_values("time")
        for h, t in zip(rows["hash"], rows["time"], strict=True):
            if h != last:
                out.append((k[0], h, t))
                last = h
        state.update((last,))
        state.setTimeoutDuration(int(pd.Timedelta(delay).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["key", "hash", "first_seen"])

    return hashed.groupBy("key").applyInPandasWithState(follow, "key string, hash string, first_seen timestamp", "hash string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_seen(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def sliding(stream: DataFrame, by: list[str], time: str, value: str, width: str, slide: str, delay: str) -> DataFrame:
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("w"), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak")).select(F.col("w.start").alias("start"), *by, "n", "mean", "peak")


def sessions(stream: DataFrame, by: list[str], time: str, gap: str, delay: str) -> DataFrame:
    s = stream.withWatermark(time, delay).groupBy(*by, F.session_window(time, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def digest(stream: DataFrame, time: str, priority: str, least: int, delay: str) -> DataFrame:
    """Alerts of at least a priority in trailing 24 hours, every hour."""
    return sliding(stream.filter(F.col(priority) >= least), [priority], time, priority, "24 hours", "1 hour", delay)
