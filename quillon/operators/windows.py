"""Ordered-sequence operators: frames, islands, resampling, rhythm, ranks.

Every window is partitioned by an entity; none orders a whole table in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.operators.density import placed
from quillon.sources.shared import stored


def by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def resample(df: DataFrame, keys: list[str], ts: str, minutes: int, aggregates: list[Column], fill_gaps: bool = True) -> DataFrame:
    """Tumbling windows from ts; with fill_gaps also the empty ones between an entity's first and last."""
    width = minutes * 60
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    slot = (F.floor(seconds / width) * width).cast("long")
    binned = df.withColumn("slot", slot)
    out = binned.groupBy(*keys, "slot").agg(*aggregates)
    if not fill_gaps:
        return out
    span = binned.groupBy(*keys).agg(F.min("slot").alias("_a"), F.max("slot").alias("_b"))
    spine = span.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(width).cast("long"))).alias("slot"))
    return spine.join(out, [*keys, "slot"], "left")


def full_frame(value: Column, keys: list[str], order: list[str], start: int, end: int) -> Column:
    """An aggregate over rows start..end, NULL until the frame is full."""
    w = by(keys, order).rowsBetween(start, end)
    return F.when(F.count(F.lit(1)).over(w) == end - start + 1, value.over(w))


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of rows with the flag set: first, last and number of rows of each."""
    w = by(keys, order)
    marked = df.withColumn("_f", flag).withColumn("_n", F.row_number().over(w))
    # Within runs of equal flags the two row numbers advance together.
    runs = marked.withColumn("_g", F.col("_n") - F.row_number().over(by([*keys, "_f"], order))).filter("_f")
    return runs.groupBy(*keys, "_g").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def successive(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Heart-rate style statistics of successive differences by entity."""
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(by(keys, order)))
    return d.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sdnn"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"), F.stddev_samp("_d").alias("sdsd"),
        (F.count_if(F.abs("_d") > 50) / F.count("_d") * 100).alias("pnn50"), (F.count_if(F.abs("_d") > 20) / F.count("_d") * 100).alias("pnn20"), (F.stddev_samp(value) / F.avg(value)).alias("cv"),
        F.sqrt(F.var_pop("_d") / 2).alias("sd1"), F.sqrt(F.greatest(2 * F.var_pop(value) - F.var_pop("_d") / 2, F.lit(0.0))).alias("sd2"),
    )


def sleep_scores(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds sadeh and sadeh_asleep (a score over 11 epochs centred, shrinking at the edges; asleep from 0), and
    cole and cole_asleep (a logistic probability of 8 weighted epochs from -2 to 5, missing ones 0; asleep from .5)."""
    w = by(keys, order)
    frame = w.rowsBetween(-5, 5)
    x = F.col(value)
    active = F.sum((x >= 50).cast("int")).over(frame)
    sixth = F.element_at(F.collect_list(value).over(frame), F.least(F.lit(6), F.count(F.lit(1)).over(frame)).cast("int"))
    sadeh = 7.601 - 0.065 * active - 0.056 * F.avg(value).over(frame) - 0.703 * F.stddev_pop(value).over(frame) - 1.08 * F.log(sixth + 1)
    # The weights of the epochs from -2 to 5.
    taps = {-2: 0.00001, -1: 0.04, 0: 1.0, 1: 0.04, 2: 0.0001, 3: 0.0001, 4: 0.0004, 5: 0.02}
    at = lambda k: x if k == 0 else (F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w))
    index = sum((F.coalesce(at(k), F.lit(0.0)) * c for k, c in taps.items()), F.lit(0.0)) / 100
    scored = df.withColumn("sadeh", sadeh).withColumn("cole", 1 / (1 + F.exp(0.37 - 0.73 * index)))
    return scored.withColumn("sadeh_asleep", F.col("sadeh") >= 0).withColumn("cole_asleep", F.col("cole") >= 0.5)


def sleep_periods(df: DataFrame, keys: list[str], order: list[str], asleep: Column, epoch_minutes: float, least_minutes: float = 180) -> DataFrame:
    """Periods of sleep with both edges seen: onset (first row asleep), offset (first row awake after it), counted
    from 0, and minutes. A run that begins with the first or ends with the last row has an edge unseen."""
    w = by(keys, order)
    marked = df.select(*keys, *(c for c in order if c not in keys), asleep.alias("_f")).withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    runs = marked.withColumn("_g", F.col("_n") - F.row_number().over(by([*keys, "_f"], order))).filter("_f")
    found = runs.groupBy(*keys, "_g").agg((F.min("_n") - 1).cast("long").alias("onset"), F.max("_n").cast("long").alias("offset"), F.first("_all").alias("_all")).filter("onset > 0 and offset < _all")
    return found.withColumn("minutes", (F.col("offset") - F.col("onset")) * epoch_minutes).filter(F.col("minutes") >= least_minutes).drop("_g", "_all")


def sleep_quality(df: DataFrame, keys: list[str], order: list[str], value: str, asleep: Column, epoch_minutes: float, sustained: int = 10) -> DataFrame:
    """Of each entity's longest period (the first of equals): tst, tib, se, waso, sol (to the first `sustained` rows
    asleep on end, else 0), awakenings of at least a minute, and sfi (transitions and the percentage of rows above the
    entity's 90th percentile, by 100)."""
    longest = sleep_periods(df, keys, order, asleep, epoch_minutes).groupBy(*keys).agg(F.min_by(F.struct("onset", "offset"), F.struct(-F.col("minutes"), F.col("onset"))).alias("_p")).select(*keys, "_p.*")
    w = by(keys, order)
    top = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.9)).alias("_top"))
    marked = df.withColumn("_f", asleep).withColumn("_n", (F.row_number().over(w) - 1).cast("long")).join(longest, keys).filter("_n >= onset and _n < offset").join(top, keys)
    ahead = w.rowsBetween(0, sustained - 1)
    fell = (F.min(F.col("_f").cast("int")).over(ahead) == 1) & (F.col("_n") < F.col("offset") - sustained)
    runs = marked.withColumn("_fell", fell).withColumn("_was", F.lag("_f").over(w)).withColumn("_woken", F.count_if(F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wake = runs.filter("not _f").groupBy(*keys, "_woken").agg(F.count(F.lit(1)).alias("_len"), F.max("_n").alias("_end"), F.first("offset").alias("_off")).filter((F.col("_len") * epoch_minutes >= 1) & (F.col("_end") < F.col("_off") - 1)).groupBy(*keys).agg(F.count(F.lit(1)).alias("awakenings"))
    n, slept = F.count(F.lit(1)), F.count_if("_f")
    moving = F.count_if(F.col(value) > F.col("_top")) / n * 100
    out = runs.groupBy(*keys).agg(
        (slept * epoch_minutes).alias("tst"), (n * epoch_minutes).alias("tib"), (slept / n * 100).alias("se"), ((n - slept) * epoch_minutes).alias("waso"),
        F.coalesce((F.min(F.when(F.col("_fell"), F.col("_n"))) - F.min("onset")) * epoch_minutes, F.lit(0.0)).alias("sol"), ((F.count_if(F.col("_f") != F.col("_was")) + moving) / 100).alias("sfi"),
    )
    return out.join(wake, keys, "left").fillna(0, ["awakenings"])


def rhythm(hourly: DataFrame, keys: list[str], hour: str, order: str, value: str) -> DataFrame:
    """Interdaily stability, intradaily variability, relative amplitude, M10 and L5 of an hourly series."""
    w = by(keys, [order])
    d = hourly.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_m10", full_frame(F.avg(value), keys, [order], 0, 9)).withColumn("_l5", full_frame(F.avg(value), keys, [order], 0, 4))
    per = d.groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("_c"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_ss"), F.sum(F.col("_d") * F.col("_d")).alias("_dd"), F.count("_d").alias("_nd"), F.max("_m10").alias("_m10"), F.min("_l5").alias("_l5"))
    n, s = F.sum("_c"), F.sum("_s")
    total = F.sum("_ss") - s * s / n
    mean = s / n
    between = F.sum((F.col("_s") / F.col("_c")) * (F.col("_s") / F.col("_c"))) - 2 * mean * F.sum(F.col("_s") / F.col("_c")) + F.count(F.lit(1)) * mean * mean
    m10, l5 = F.max("_m10"), F.min("_l5")
    return per.groupBy(*keys).agg((n * between / (F.count(F.lit(1)) * total)).alias("is"), ((n * F.sum("_dd")) / (F.sum("_nd") * total)).alias("iv"), m10.alias("m10"), l5.alias("l5"), ((m10 - l5) / (m10 + l5)).alias("ra"))


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """First and last value, slope, area under the curve, and area above the first value, by entity."""
    w = by(keys, [x])
    d = df.withColumn("_px", F.lag(x).over(w)).withColumn("_py", F.lag(y).over(w))
    area = F.sum((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / 2)
    first = F.min_by(y, x)
    return d.groupBy(*keys).agg(first.alias("first"), F.max_by(y, x).alias("last"), F.regr_slope(y, x).alias("slope"), area.alias("auc"), (area - first * (F.max(x) - F.min(x))).alias("auci"))


def threshold_crossing(levels: DataFrame, keys: list[str], level: str, accuracy: str, target: float) -> DataFrame:
    """First level with accuracy at the target, interpolated from the level before."""
    w = by(keys, [level])
    d = levels.withColumn("_pl", F.lag(level).over(w)).withColumn("_pa", F.lag(accuracy).over(w)).filter(F.col(accuracy) >= target)
    first = d.groupBy(*keys).agg(F.min_by(F.struct(level, accuracy, "_pl", "_pa"), level).alias("_r")).select(*keys, "_r.*")
    inside = F.col("_pl") + (target - F.col("_pa")) / (F.col(accuracy) - F.col("_pa")) * (F.col(level) - F.col("_pl"))
    return first.select(*keys, F.when(F.col("_pl").isNull() | (F.col("_pa") >= target), F.col(level)).otherwise(inside).alias("threshold"))


def enrichment(ranked: DataFrame, keys: list[str], score: str, member: str, tie: str) -> DataFrame:
    """Running-sum enrichment of flagged items down a ranking: es and its position, by set."""
    w = Window.partitionBy(*keys)
    down = by(keys, [F.desc(score), tie]).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col(member), F.abs(score)).otherwise(0.0)
    hit = F.sum(weight).over(down) / F.nullif(F.sum(weight).over(w), F.lit(0.0))
    miss = F.sum(F.when(F.col(member), 0).otherwise(1)).over(down) / F.nullif(F.sum(F.when(F.col(member), 0).otherwise(1)).over(w), F.lit(0))
    run = ranked.withColumn("_r", hit - miss).withColumn("_n", F.row_number().over(by(keys, [F.desc(score), tie])))
    peak = F.max_by(F.struct(F.col("_r").alias("es"), F.col("_n").alias("at")), F.struct(F.abs("_r"), -F.col("_n"))).over(w)
    met = run.withColumn("_e", peak).withColumn("_lead", F.col(member) & F.when(F.col("_e.es") >= 0, F.col("_n") <= F.col("_e.at")).otherwise(F.col("_n") > F.col("_e.at")))
    return met.groupBy(*keys).agg(F.first("_e").alias("_e"), F.count_if("_lead").alias("leading")).select(*keys, "_e.*", "leading")


#: Ranked items of a chunk, which one task holds.
CHUNK = 65_536


def chunk_ends(weights: np.ndarray, at: np.ndarray, start: int, hits: float, found: int, total: float, size: int, n: int) -> tuple[float, float]:
    """The highest and the lowest running sum at a chunk's hits, given as ascending positions in it: just after and just
    before each. `start` items, `found` hits and the weight `hits` come before the chunk; `total` is all hits' weight."""
    if not len(at):
        return -np.inf, np.inf
    h = hits + np.cumsum(weights[at])
    misses = (start + at - found - np.arange(len(at))) / max(1, n - size)
    share = lambda v: v / total if total > 0 else np.zeros_like(v)
    return float((share(h) - misses).max()), float((share(np.concatenate([[hits], h[:-1]])) - misses).min())


def preranked(members: DataFrame, item: str, score: str, name: str, permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(set, size, es, nes, p) of each set of items among all items of members, ranked by score: nes is es by the mean of
    random sets' scores of its sign, p their share that is as extreme. Any number of items: the ranking is cut into chunks.
    Tasks draw each random set's part of their chunk, once for its weight and again, from the same seeds, for the running
    sums; how many hits a chunk has is drawn first, from the chunks' sizes. Sets of one size share random sets."""
    spark = members.sparkSession
    best = members.groupBy(item).agg(F.max(score).alias("score")).select(F.col(item).alias("item"), "score")
    ranked = placed(best, [F.desc("score"), F.col("item")]).select("item", F.abs("score").cast("double").alias("w"), (F.col("place") / CHUNK).cast("long").alias("chunk"), (F.col("place") % CHUNK).cast("int").alias("at"))
    ranked = stored(ranked)
    n = ranked.count()
    held = stored(members.select(F.col(item).alias("item"), F.col(name).alias("set")).distinct().join(ranked, "item"))
    sizes = sorted({r["n"] for r in held.groupBy("set").agg(F.count(F.lit(1)).alias("n")).select("n").distinct().collect()})
    chunks = -(-n // CHUNK)
    length = lambda c: min(CHUNK, n - c * CHUNK)

    def drawn(chunk: int):
        """(size, draw, hits before, positions) of each random set in a chunk: hits fall to chunks one after the other."""
        for m in sizes:
            for t in range(permutations):
                rng, left, rest, before = np.random.default_rng([seed, m, t]), m, n, 0
                for c in range(chunk + 1):
                    got = int(rng.hypergeometric(length(c), rest - length(c), left)) if left and rest > length(c) else left
                    left, rest, before = left - got, rest - length(c), before + got
                yield m, t, before - got, np.sort(np.random.default_rng([seed, m, t, chunk]).choice(length(chunk), got, replace=False, shuffle=False))

    def weighed(pdf: pd.DataFrame) -> pd.DataFrame:
        w, chunk = pdf.sort_values("at")["w"].to_numpy(), int(pdf["chunk"].iloc[0])
        rows = [(m, t, float(w[at].sum())) for m, t, _, at in drawn(chunk)]
        return pd.DataFrame({"chunk": chunk, "size": [r[0] for r in rows], "draw": [r[1] for r in rows], "w": [r[2] for r in rows]})

    def sums(df: DataFrame, by: list[str]) -> DataFrame:
        """With the weight in the chunks before, `hits`, and that of all, `total`."""
        w = Window.partitionBy(*by)
        return df.withColumn("hits", F.coalesce(F.sum("w").over(w.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("w").over(w))

    def extremes(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        w, before = pdf.sort_values("at")["w"].to_numpy(), {(m, t): (h, s) for m, t, h, s in zip(known["size"], known["draw"], known["hits"], known["total"], strict=True)}
        rows = [(m, t, *chunk_ends(w, at, key[0] * CHUNK, before[m, t][0], found, before[m, t][1], m, n)) for m, t, found, at in drawn(key[0])]
        return pd.DataFrame(rows, columns=["size", "draw", "high", "low"])

    weights = stored(ranked.groupBy("chunk").applyInPandas(weighed, "chunk long, size long, draw long, w double"))
    ends = ranked.groupBy("chunk").cogroup(sums(weights, ["size", "draw"]).groupBy("chunk")).applyInPandas(extremes, "size long, draw long, high double, low double")
    score_of = lambda: F.when(F.abs(F.least(F.min("low"), F.lit(0.0))) > F.max("high"), F.least(F.min("low"), F.lit(0.0))).otherwise(F.max("high"))
    random = stored(ends.groupBy("size", "draw").agg(score_of().alias("r")))

    own = held.groupBy("set", "chunk").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"))
    every = Window.partitionBy("set")
    own = sums(own, ["set"]).withColumn("found", F.coalesce(F.sum("k").over(every.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("k").over(every))

    def own_ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, f = pdf.sort_values("at"), pdf.iloc[0]
        w = np.zeros(CHUNK)
        w[pdf["at"]] = pdf["w"]
        high, low = chunk_ends(w, pdf["at"].to_numpy(), int(f["chunk"]) * CHUNK, f["hits"], int(f["found"]), f["total"], int(f["size"]), n)
        return pd.DataFrame({"set": [f["set"]], "size": [int(f["size"])], "high": [high], "low": [low]})

    kind = members.schema[name].dataType.simpleString()
    whole = held.join(own.select("set", "chunk", "hits", "total", "found", "size"), ["set", "chunk"]).groupBy("set", "chunk").applyInPandas(own_ends, f"set {kind}, size long, high double, low double")
    es = whole.groupBy("set", "size").agg(score_of().alias("es"))
    same = es.join(random, "size").filter((F.col("es") >= 0) == (F.col("r") >= 0)).groupBy("set").agg(F.abs(F.avg("r")).alias("mean"), F.avg((F.abs("r") >= F.abs("es")).cast("double")).alias("p"))
    return es.join(same, "set", "left").select(F.col("set").alias(name), "size", "es", F.when(F.col("mean") > 0, F.col("es") / F.col("mean")).otherwise(0.0).alias("nes"), F.coalesce("p", F.lit(1.0)).alias("p"))


def ranks(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """average_rank (ties averaged) and ordinal (0-based)."""
    return df.withColumn("average_rank", S.average_rank(keys, value)).withColumn("ordinal", F.row_number().over(by(keys, [value, tie])) - 1)


def widest_gap(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The largest difference of neighbours in sorted order, and the value below it."""
    g = df.withColumn("_p", F.lag(value).over(by(keys, [value]))).filter("_p is not null").withColumn("_g", F.col(value) - F.col("_p"))
    return g.groupBy(*keys).agg(F.max("_g").alias("gap"), F.max_by("_p", F.struct("_g", -F.col("_p"))).alias("below"))


def transition_rate(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean absolute change from frame to frame and the slope over frames, for series of two frames or more."""
    w = by(keys, order)
    d = df.withColumn("_frame", F.row_number().over(w) - 1).withColumn("_rate", F.abs(F.col(value) - F.lag(value).over(w)))
    return d.groupBy(*keys).agg(F.avg("_rate").alias("rate_per_frame"), F.regr_slope(value, "_frame").alias("slope"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def energy_peaks(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Peaks of a series' integrated energy, with the gap to the one before: squared differences averaged over an odd
    width (nothing beyond the ends), local maxima above the series' mean. The band-pass filter comes before, if any."""
    w, half = by(keys, order), width // 2
    d = df.select(*keys, F.row_number().over(w).alias("i"), F.pow(F.col(value) - F.lag(value).over(w), 2).alias("_e")).filter("_e is not null")
    m = d.withColumn("_m", F.round(F.sum("_e").over(by(keys, ["i"]).rowsBetween(-half, half)) / width, 6))
    at = by(keys, ["i"])
    level = F.round(F.avg("_m").over(Window.partitionBy(*keys)), 6)
    t = m.withColumns({"_before": F.lag("_m").over(at), "_after": F.lead("_m").over(at), "_level": level})
    peaks = t.filter((F.col("_m") > F.col("_before")) & (F.col("_m") >= F.col("_after")) & (F.col("_m") > F.col("_level")))
    return peaks.select(*keys, "i", (F.col("i") - F.lag("i").over(at)).alias("gap"))
