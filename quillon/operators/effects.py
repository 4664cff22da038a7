"""Effects of a treatment that differ between rows: an honest forest from histograms, and effects by groups.

All trees grow level by level together: one pass in which tasks add up rows and outcomes by tree,
node, feature, bin and arm. Rows don't move; the driver holds these sums and the trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.operators.neighbours import matrix
from quillon.operators.nulls import _summing, mixed
from quillon.sources.shared import stored


class CausalForest:
    """Trees for the effect of a 0/1 treatment (Athey and Imbens 2016).

    A hash of key and tree puts each row in one of three parts: the first chooses splits, the second gives a leaf's effect
    (mean outcome of treated less untreated rows), the third takes no part in that tree. A split is the one of `tries` drawn features and all
    their bins with the largest gain, n_left * n_right / n^2 * (difference of effects)^2, with at least `least` rows of each
    arm on both sides, in the first part. A leaf whose second part lacks an arm takes its parent's effect. Features are cut
    at `bins` approximate quantiles. Rows with a null or NaN in treatment, outcome or a feature aren't fitted.
    """

    def __init__(self, rows: DataFrame, key: str, features: list[str], treatment: str, outcome: str, trees: int = 50, depth: int = 4, least: int = 10, bins: int = 32, tries: int | None = None, seed: int = 42):
        self.key, self.features, self.trees, self.depth, self.seed = key, features, trees, depth, seed
        p, rng = len(features), np.random.default_rng(seed)
        tries = min(p, tries or max(1, int(np.ceil(p * 2 / 3))))
        real = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        fed = stored(rows.select(F.xxhash64(F.col(key), F.lit(seed)).alias("key"), F.array(*(real(c) for c in features)).alias("x"), (real(treatment) == 1).alias("w"), real(outcome).alias("y"))
                     .filter(F.col("w").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull())))
        shares = [i / bins for i in range(1, bins)]
        marks = fed.agg(*(F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000) for i in range(p)), F.avg("y")).first()
        self.edges = [np.unique(np.array(m if m is not None else [], float)) for m in marks[:p]]
        centre = marks[p] or 0.0
        # heap of nodes, root 1; feature -1: a leaf. Sums of the second part by node: n and y of untreated, treated.
        nodes = 1 << (depth + 1)
        self.feature, self.cut = np.full((trees, nodes), -1), np.zeros((trees, nodes), int)
        for level in range(depth):
            first, width = 1 << level, 1 << level
            size = trees * width * p * bins * 4

            def grow(total, b, first=first, width=width):
                binned, keys, w, y = self._batch(b)
                y = y - centre
                table = total.reshape(trees, width * p * bins * 2, 2)
                for m in range(trees):
                    at = self._leaf(m, binned, level)
                    own = (mixed(keys, m) % np.uint64(3) == 0) & (at >= first)
                    for j in range(p):
                        slot = (((at[own] - first) * p + j) * bins + binned[own, j]) * 2 + w[own]
                        table[m, :, 0] += np.bincount(slot, minlength=table.shape[1])
                        table[m, :, 1] += np.bincount(slot, weights=y[own], minlength=table.shape[1])

            table = _summing(fed, size, grow).reshape(trees, width, p, bins, 2, 2)
            for m in range(trees):
                for v in range(width):
                    allowed = rng.permutation(p)[:tries]
                    best = _best_split(table[m, v], allowed, least)
                    if best is not None:
                        self.feature[m, first + v], self.cut[m, first + v] = best

        def estimate(total, b):
            binned, keys, w, y = self._batch(b)
            y = y - centre
            table = total.reshape(trees, nodes, 2, 2)
            for m in range(trees):
                own = mixed(keys, m) % np.uint64(3) == 1
                at = self._leaf(m, binned[own], depth)
                np.add.at(table[m, :, :, 0], (at, w[own]), 1.0)
                np.add.at(table[m, :, :, 1], (at, w[own]), y[own])

        table = _summing(fed, trees * nodes * 4, estimate).reshape(trees, nodes, 2, 2)
        for v in range(nodes - 1, 1, -1):
            table[:, v >> 1] += table[:, v]
        n, y = table[..., 0], table[..., 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            effect = y[..., 1] / n[..., 1] - y[..., 0] / n[..., 0]
        for v in range(2, nodes):
            effect[:, v] = np.where(np.isnan(effect[:, v]), effect[:, v >> 1], effect[:, v])
        self.effect = effect

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def _batch(self, b: pa.RecordBatch):
        return self._binned(matrix(b.column(1))), b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).to_numpy()

    def _leaf(self, m: int, binned: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; rows of a leaf stay in it."""
        at, rows = np.ones(len(binned), np.int64), np.arange(len(binned))
        for _ in range(levels):
            f = self.feature[m, at]
            go = 2 * at + (binned[rows, np.maximum(f, 0)] > self.cut[m, at])
            at = np.where(f >= 0, go, at)
        return at

    def scored(self, rows: DataFrame, out: str = "effect") -> DataFrame:
        """rows with the mean effect of the trees in whose first two parts a row's key isn't, so that its own outcome takes no
        part; of all trees if there is none. NULL where a feature is missing or the forest has seen an arm nowhere."""
        fed = rows.withColumn("_hash", F.xxhash64(F.col(self.key), F.lit(self.seed))).withColumn("_x", F.array(*(F.col(c).cast("double") for c in self.features)))
        kept = rows.columns

        def score(batches):
            for b in batches:
                x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.features))
                whole, keys = ~np.isnan(x).any(1), b.column("_hash").to_numpy()
                binned, total, every, n = self._binned(np.nan_to_num(x)), np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
                for m in range(self.trees):
                    e = self.effect[m, self._leaf(m, binned, self.depth)]
                    mine = mixed(keys, m) % np.uint64(3) == 2
                    total, every, n = total + np.where(mine, e, 0.0), every + e, n + mine
                got = np.where(n > 0, total / np.maximum(n, 1), every / self.trees)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.where(whole, got, np.nan), from_pandas=True)], names=[*kept, out])

        return fed.mapInArrow(score, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def _best_split(table: np.ndarray, allowed: np.ndarray, least: int) -> tuple[int, int] | None:
    """(feature, last bin of the left side) by gain, of sums by feature, bin, arm; the first of equal ones."""
    left = table.cumsum(1)
    right = left[:, -1:] - left
    n, y = np.stack([left[..., 0], right[..., 0]]), np.stack([left[..., 1], right[..., 1]])
    with np.errstate(invalid="ignore", divide="ignore"):
        effect = y[..., 1] / n[..., 1] - y[..., 0] / n[..., 0]
        rows = n.sum(-1)
        gain = rows[0] * rows[1] / rows.sum(0) ** 2 * (effect[0] - effect[1]) ** 2
    gain = np.where((n >= least).all((0, -1)), gain, -np.inf)[np.sort(allowed)]
    if not np.isfinite(gain.max(initial=-np.inf)) or gain.max() <= 0:
        return None
    j, k = np.unravel_index(gain.argmax(), gain.shape)
    return int(np.sort(allowed)[j]), int(k)


def grouped_effects(df: DataFrame, group: str | Column, treatment: str, outcome: str, z: float = 1.959963984540054) -> DataFrame:
    """(group, n, treated, effect, se, low, high): difference of mean outcomes of treated and untreated rows by group, with the
    interval of unequal variances. Rows without treatment or outcome are left out; effects of groups without an arm are NULL."""
    on, off = F.col(treatment) == 1, F.col(treatment) != 1
    y = F.col(outcome)
    d = df.select((F.col(group) if isinstance(group, str) else group).alias("group"), treatment, outcome).filter(F.col(treatment).isNotNull() & y.isNotNull())
    one, two = F.when(on, y), F.when(off, y)
    g = d.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count(one).alias("treated"), (F.avg(one) - F.avg(two)).alias("effect"), F.sqrt(F.var_samp(one) / F.count(one) + F.var_samp(two) / F.count(two)).alias("se"))
    return g.select("group", "n", "treated", "effect", "se", (F.col("effect") - z * F.col("se")).alias("low"), (F.col("effect") + z * F.col("se")).alias("high"))


def quantile_groups(scored: DataFrame, effect: str, treatment: str, outcome: str, groups: int = 4, accuracy: int = 10_000) -> DataFrame:
    """grouped_effects by quantiles of the scored effect, from 0 (the smallest), with the mean score of each group. The bounds are
    approximate quantiles, off by at most 1 / accuracy of the rows; rows without a score are left out."""
    d = scored.filter(F.col(effect).isNotNull())
    bounds = d.agg(F.percentile_approx(effect, [i / groups for i in range(1, groups)], accuracy)).first()[0] or []
    at = sum(((F.col(effect) > b).cast("int") for b in bounds), F.lit(0))
    d = d.withColumn("_group", at)
    means = d.groupBy(F.col("_group").alias("group")).agg(F.avg(effect).alias("score"))
    return grouped_effects(d, "_group", treatment, outcome).join(means, "group")
