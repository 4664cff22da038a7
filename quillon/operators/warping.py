"""Clusters of trajectories by dynamic time warping.

Centres are few and of one length; each series meets them in a task, so rows don't move. A lower bound
(Keogh's envelope of a centre) decides which centres a series has to be warped to, and the new centres are
means along the warping paths (Petitjean et al. 2011), from sums by centre and position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.neighbours import matrix
from quillon.operators.nulls import _summing, uniforms
from quillon.sources.shared import dropped, stored


def costs(series: np.ndarray, centre: np.ndarray, band: int) -> np.ndarray:
    """Least squared costs of all pairs of prefixes, (rows, length + 1, length + 1), of series (rows, length, features) and one
    centre; positions further apart than band don't meet."""
    n, t, _ = series.shape
    local = ((series[:, :, None] - centre[None, None]) ** 2).sum(3)
    out = np.full((n, t + 1, t + 1), np.inf)
    out[:, 0, 0] = 0.0
    for i in range(1, t + 1):
        for j in range(max(1, i - band), min(t, i + band) + 1):
            out[:, i, j] = local[:, i - 1, j - 1] + np.minimum(np.minimum(out[:, i - 1, j], out[:, i, j - 1]), out[:, i - 1, j - 1])
    return out


def lower_bounds(series: np.ndarray, centre: np.ndarray, band: int) -> np.ndarray:
    """Squared distances to the centre's envelope within the band: never over the squared cost."""
    t = len(centre)
    low = np.stack([centre[max(0, i - band) : i + band + 1].min(0) for i in range(t)])
    high = np.stack([centre[max(0, i - band) : i + band + 1].max(0) for i in range(t)])
    return (np.maximum(np.maximum(series - high, low - series), 0.0) ** 2).sum((1, 2))


def nearest(series: np.ndarray, centres: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(centre, squared cost) of each series, ties to the smaller number, and how many pairs were warped."""
    rows = np.arange(len(series))
    bounds = np.stack([lower_bounds(series, c, band) for c in centres], 1)
    order = np.argsort(bounds, 1, kind="stable")
    best, at, warped = np.full(len(series), np.inf), np.zeros(len(series), np.int64), 0
    for k in range(len(centres)):  # each series' k-th centre by bound
        own = order[:, k]
        left = bounds[rows, own] * (1 - 1e-12) <= best
        for c in np.unique(own[left]):
            some = np.flatnonzero(left & (own == c))
            cost = costs(series[some], centres[c], band)[:, -1, -1]
            closer = (cost < best[some]) | ((cost == best[some]) & (c < at[some]))
            best[some[closer]], at[some[closer]] = cost[closer], c
            warped += len(some)
    return at, best, warped


def path_sums(series: np.ndarray, centre: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """By position of the centre, the sums and numbers of the series' values that the best paths bring there."""
    n, t, f = series.shape
    table, rows = costs(series, centre, band), np.arange(n)
    i, j = np.full(n, t), np.full(n, t)
    sums, counts = np.zeros((t, f)), np.zeros(t)
    while len(rows):
        np.add.at(sums, j - 1, series[rows, i - 1])
        np.add.at(counts, j - 1, 1.0)
        steps = np.stack([table[rows, i - 1, j - 1], table[rows, i - 1, j], table[rows, i, j - 1]])
        way = steps.argmin(0)
        i, j = i - (way != 2), j - (way != 1)
        going = (i > 0) & (j > 0)
        rows, i, j = rows[going], i[going], j[going]
    return sums, counts


def _reader(length: int, features: int, scale: bool):
    """A column of series as an array (rows, length, features)."""

    def read(column: pa.Array) -> np.ndarray:
        x = matrix(column).reshape(-1, length, features)
        if not scale:
            return x
        sd = x.std(1, keepdims=True)
        return (x - x.mean(1, keepdims=True)) / np.where(sd > 1e-12 * np.maximum(1.0, np.abs(x).max(1, keepdims=True)), sd, np.inf)

    return read


class TrajectoryClusters:
    """k clusters of series, each an array of `length` times `features` values in order of time, by k-means under time warping.

    A series is first standardised by feature over its own times (constant features become zero) unless scale is false. The first
    centres are series drawn with a probability that grows with their squared distance from those before, by hashes of their
    key. Rounds end when no centre moves by more than tol, or after `rounds`. A cluster that loses its rows keeps its centre.
    Series with a missing value or of another length are left out; fewer distinct series than k make fewer clusters. Keys should be
    unique, repeated rows count each. Driver and tasks hold k series.
    """

    def __init__(self, rows: DataFrame, key: str, series: str, length: int, features: int = 1, k: int = 5, band: int | None = None, rounds: int = 10, tol: float = 1e-6, scale: bool = True, seed: int = 42):
        self.key, self.length, self.features, self.read = key, length, features, _reader(length, features, scale)
        self.band = length if band is None else band
        self.kind = rows.select(key).schema[0].dataType.simpleString()
        real = F.transform(F.col(series).cast("array<double>"), lambda v: F.nanvl(v, F.lit(None).cast("double")))
        fed = rows.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.lit(seed)).alias("hash"), real.alias("x")).filter((F.size("x") == length * features) & ~F.exists("x", lambda v: v.isNull()))
        self.rows = stored(fed)
        self.centres = np.zeros((0, length, features))
        for c in range(k):
            drawn = self._draw(c)
            if drawn is None:
                break
            self.centres = np.concatenate([self.centres, drawn[None]])
        self.rounds = 0
        while len(self.centres) and self.rounds < rounds:
            self.rounds += 1
            if self._move() <= tol:
                break

    def _draw(self, c: int) -> np.ndarray | None:
        read, centres, band = self.read, self.centres, self.band

        def race(batches):
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                x, wait = read(b.column(1)), -np.log(np.maximum(1 - uniforms(b.column(0).to_numpy(), c + 1)[:, c], 1e-300))
                weight = nearest(x, centres, band)[1] if c else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    wait = np.where(weight > 1e-12, wait / weight, np.inf)
                i = int(wait.argmin())
                if np.isfinite(wait[i]) and (best is None or wait[i] < best[0]):
                    best = (float(wait[i]), x[i].ravel().tolist())
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.list_(pa.float64()))], names=["wait", "x"])

        row = self.rows.select("hash", "x").mapInArrow(race, "wait double, x array<double>").agg(F.min_by("x", F.struct("wait", "x")).alias("x")).first()
        return None if row["x"] is None else np.array(row["x"]).reshape(self.length, self.features)

    def _move(self) -> float:
        read, centres, band = self.read, self.centres, self.band
        k, t, f = centres.shape

        def add(total, b):
            table, x = total.reshape(k, t, f + 1), read(b.column(0))
            at = nearest(x, centres, band)[0]
            for c in np.unique(at):
                sums, counts = path_sums(x[at == c], centres[c], band)
                table[c, :, :f] += sums
                table[c, :, f] += counts

        table = _summing(self.rows.select("x"), k * t * (f + 1), add).reshape(k, t, f + 1)
        counts = table[:, :, f:]
        new = np.where(counts > 0, table[:, :, :f] / np.maximum(counts, 1.0), self.centres)
        moved, self.centres = float(np.abs(new - self.centres).max()), new
        return moved

    def assigned(self) -> DataFrame:
        """(key, cluster, distance) of every series, the distance being the root of the warped squared cost."""
        key, kind, read, centres, band = self.key, self.kind, self.read, self.centres, self.band

        def deal(batches):
            for b in batches:
                if b.num_rows:
                    at, cost, _ = nearest(read(b.column(1)), centres, band)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(np.sqrt(cost))], names=[key, "cluster", "distance"])

        return self.rows.select("key", "x").mapInArrow(deal, f"`{key}` {kind}, cluster int, distance double")

    def pruned(self) -> float:
        """The share of pairs of series and centres that the bound spares, with the final centres."""
        read, centres, band = self.read, self.centres, self.band
        if not len(centres):
            return 0.0

        def add(total, b):
            x = read(b.column(0))
            total += [nearest(x, centres, band)[2], len(x) * len(centres)]

        warped, pairs = _summing(self.rows.select("x"), 2, add)
        return float(1 - warped / pairs) if pairs else 0.0

    def close(self) -> None:
        dropped(self.rows)
