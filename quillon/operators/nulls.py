"""Null distributions of clusterings: exact permutations of labels, uniform references (gap), Gaussian references (SigClust).

Random numbers are hashes of a row's key and the draw. No pass moves rows: tasks send
counts and sums by draw and group, and the driver holds these.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.neighbours import matrix
from quillon.operators.sparse import normals
from quillon.sources.shared import dropped, stored

BITS = 10
#: (rows of each group, sums of each group's vectors, sum of all squares) to a number
Statistic = Callable[[np.ndarray, np.ndarray, float], float]


def within(n: np.ndarray, sums: np.ndarray, squares: float) -> float:
    """Squared distances of rows to the mean of their group."""
    return max(float(squares - ((sums**2).sum(1)[n > 0] / n[n > 0]).sum()), 0.0)


def tightness(n: np.ndarray, sums: np.ndarray, squares: float) -> float:
    return -float(np.log(within(n, sums, squares) + 1e-10))


def mixed(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number below 2**64 for each 64-bit key, another one for each key: equal keys alone are equal."""
    x = keys.view(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, columns: int) -> np.ndarray:
    """A row of numbers between 0 and 1 for each 64-bit key."""
    return np.stack([(mixed(keys, j) >> np.uint64(11)).astype(float) / 2**53 for j in range(columns)], 1)


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of all tasks' arrays s of one size."""
    out = np.zeros(size)
    for r in parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _summing(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                add(total, b)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    return _added(rows.mapInArrow(run, "s array<double>"), size)


def cuts(rows: DataFrame, sizes: np.ndarray, draws: int) -> np.ndarray:
    """By draw, the largest hashes of all groups but the last, if the rows (key) in the order of their hashes are dealt to
    groups of these sizes: selection by digits, a pass for each ten bits that are still needed."""
    ends = np.cumsum(sizes)[:-1]
    out = np.zeros((draws, len(ends)), np.uint64)
    open_ = [(m, e, 0, int(k)) for m in range(draws) for e, k in enumerate(ends)]  # draw, end, digits so far, rows that are left
    for low in range(64 - BITS, -BITS, -BITS):
        if not open_:
            break
        low, bits = max(low, 0), BITS if low >= 0 else BITS + low
        wanted, high = list(open_), low + bits

        def count(total, b, low=low, bits=bits, high=high, wanted=wanted):
            keys, last, h = b.column(0).to_numpy(), -1, None
            table = total.reshape(len(wanted), 1 << bits)
            for i, (m, _, prefix, _) in enumerate(wanted):
                if m != last:
                    h, last = mixed(keys, m), m
                own = h if high == 64 else h[(h >> np.uint64(high)) == np.uint64(prefix)]
                table[i] += np.bincount(((own >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)

        table = _summing(rows.select("key"), len(wanted) << bits, count).reshape(len(wanted), -1).astype(np.int64)
        open_ = []
        for (m, e, prefix, k), counts in zip(wanted, table, strict=True):
            if k == 0:
                continue  # a group without rows ends where the one before does
            upto = np.cumsum(counts)
            j = int(np.searchsorted(upto, k))
            digits = (prefix << bits) | j
            if upto[j] == k or low == 0:  # low == 0: rows of one key stay together
                out[m, e] = np.uint64(((digits + 1) << low) - 1)
            else:
                open_.append((m, e, digits, k - int(upto[j] - counts[j])))
    return out


def permutation_test(points: DataFrame, key: str, vector: str, label: str, statistic: Statistic = tightness, draws: int = 100, seed: int = 42, two_sided: bool = False) -> DataFrame:
    """One row (observed, null_mean, null_std, p, groups, draws): a statistic of groups against permutations of labels.

    Every permutation keeps the groups' sizes: rows in the order of a hash of their key are dealt to groups, where the
    ends of groups are selected exactly, without a sort. p is the share of permutations whose statistic is at least the
    observed one, of absolute values if two_sided. Groups are held on the driver, draws by groups by dimensions. Rows
    without a label or vector are left out; with fewer than two groups no row is returned. Keys should be unique: rows of
    one key go to one group, so that sizes can differ by them; the statistic takes the real sizes.
    """
    spark = points.sparkSession
    rows = stored(points.select(F.xxhash64(F.col(key), F.lit(seed)).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")).dropna())
    first = rows.select(F.size("x").alias("p")).first()
    counted = rows.groupBy("label").count().orderBy("label").collect()
    schema = "observed double, null_mean double, null_std double, p double, groups long, draws long"
    if len(counted) < 2:
        return spark.createDataFrame([], schema)
    g, p = len(counted), first["p"]
    names, sizes = {r["label"]: i for i, r in enumerate(counted)}, np.array([r["count"] for r in counted])
    ends = cuts(rows, sizes, draws)

    def add(total, b):
        x, keys = matrix(b.column(2)), b.column(0).to_numpy()
        one = np.column_stack([np.ones(len(x)), x])
        table = total[:-1].reshape(draws + 1, g, p + 1)
        for m in range(draws + 1):
            at = np.array([names[v] for v in b.column(1).to_pylist()]) if m == draws else np.searchsorted(ends[m], mixed(keys, m), side="left")
            for k in np.unique(at):
                table[m, k] += one[at == k].sum(0)
        total[-1] += (x * x).sum()

    total = _summing(rows.select("key", "label", "x"), (draws + 1) * g * (p + 1) + 1, add)
    table = total[:-1].reshape(draws + 1, g, p + 1)
    dropped(rows)
    got = np.array([statistic(t[:, 0], t[:, 1:], total[-1]) for t in table])
    null, seen = got[:-1], got[-1]
    # sums of the same rows in another order differ in their last digits
    above = np.abs(null) >= np.abs(seen) * (1 - 1e-12) if two_sided else null >= seen - 1e-12 * abs(seen)
    return spark.createDataFrame([(float(seen), float(null.mean()), float(null.std()), float(above.mean()), g, draws)], schema)


def _moments(rows: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and samples' covariances of x."""
    mean = rows.agg(F.count(F.lit(1)), *(F.avg(F.get("x", F.lit(i))) for i in range(p))).first()
    centre = np.array(mean[1:], float)

    def add(total, b):
        x = matrix(b.column(0)) - centre
        total += (x.T @ x).ravel()

    return mean[0], centre, _summing(rows.select("x"), p * p, add).reshape(p, p) / max(mean[0] - 1, 1)


def _reference(rows: DataFrame, draw: Callable[[np.ndarray], np.ndarray], seed: int) -> DataFrame:
    """A table of as many rows, x drawn from hashes of keys."""

    def run(batches):
        for b in batches:
            x = draw(mixed(b.column(0).to_numpy(), seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], names=["x"])

    return rows.select("key").mapInArrow(run, "x array<double>")


def _cost(rows: DataFrame, k: int, seed: int) -> float:
    """Squared distances to the nearest of k centres that k-means finds."""
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows.select(array_to_vector("x").alias("features"))).summary.trainingCost


def _clustered(points: DataFrame, key: str, vector: str, label: str):
    rows = stored(points.select(F.xxhash64(F.col(key)).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")).dropna())
    first = rows.select(F.size("x").alias("p")).first()
    if first is None:
        return rows, 0, 0, 0.0
    p = first["p"]
    means = rows.groupBy("label").agg(F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(p))).alias("m"))
    gap = F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return rows, p, means.count(), rows.join(means, "label").agg(F.sum(gap)).first()[0]


def gap_statistic(points: DataFrame, key: str, vector: str, label: str, references: int = 10, seed: int = 42) -> DataFrame:
    """One row (gap, within, null_mean, null_std, groups): the mean over references of log(squared distances within
    k-means clusters), less that of the given groups. References are uniform over the columns' ranges, as many rows as
    the points. Rows without a label or vector are left out; with fewer than two groups the result is empty."""
    rows, p, k, own = _clustered(points, key, vector, label)
    spark, schema = points.sparkSession, "gap double, within double, null_mean double, null_std double, groups long"
    if k < 2 or own <= 0:
        return spark.createDataFrame([], schema)
    ends = rows.agg(*(f(F.get("x", F.lit(i))) for f in (F.min, F.max) for i in range(p))).first()
    low, high = np.array(ends[:p]), np.array(ends[p:])
    logs = np.array([np.log(max(_cost(_reference(rows, lambda h: low + uniforms(h, p) * (high - low), seed + m), k, seed), 1e-300)) for m in range(references)])
    dropped(rows)
    return spark.createDataFrame([(float(logs.mean() - np.log(own)), float(own), float(logs.mean()), float(logs.std()), k)], schema)


def sigclust(points: DataFrame, key: str, vector: str, label: str, draws: int = 20, seed: int = 42) -> DataFrame:
    """One row (observed, null_mean, null_std, p, groups): the ratio of squares between and within the given groups by
    their degrees of freedom (Calinski and Harabasz), against k-means clusters of Gaussian tables with the points' mean and covariances (Liu et al. 2008); p is the share of
    draws that reach the observed one. Rows and empty results as in gap_statistic."""
    rows, p, k, own = _clustered(points, key, vector, label)
    spark, schema = points.sparkSession, "observed double, null_mean double, null_std double, p double, groups long"
    if k < 2:
        return spark.createDataFrame([], schema)
    n, mean, cov = _moments(rows, p)
    values, axes = np.linalg.eigh(cov)
    factor = axes * np.sqrt(np.maximum(values, 0.0))
    index = lambda total, inner: float((total - inner) / (k - 1) / max(inner / max(n - k, 1), 1e-300))
    null = []
    for m in range(draws):
        drawn = _reference(rows, lambda h: mean + normals(h, p) @ factor.T, seed + m)
        total = np.trace(_moments(drawn, p)[2]) * (n - 1)
        null.append(index(total, _cost(drawn, k, seed)))
    seen, null = index(np.trace(cov) * (n - 1), own), np.array(null)
    dropped(rows)
    return spark.createDataFrame([(seen, float(null.mean()), float(null.std()), float((null >= seen).mean()), k)], schema)
