"""Stability selection: how often a lasso keeps a column over subsamples, from one pass of sums by draw and fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.neighbours import matrix
from quillon.operators.nulls import _summing, mixed
from quillon.operators.sparse import lasso
from quillon.sources.shared import dropped, stored


def _moments(s: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    n = max(s[0], 1.0)
    m = s[1 : p + 1] / n
    return s[0], m, s[p + 1 :].reshape(p, p) / n - np.outer(m, m)


def _fitted(folds: np.ndarray, p: int, alphas: int) -> np.ndarray:
    """Coefficients of the lasso of the penalty with the least held-out squared error, of sums by fold (target last)."""
    whole = folds.sum(0)
    _, _, cov = _moments(whole, p)
    most = float(np.abs(cov[:-1, -1]).max(initial=0.0))
    if most <= 0:
        return np.zeros(p - 1)
    grid, error = np.logspace(np.log10(most) - 3, np.log10(most), alphas), np.zeros(alphas)
    for f in folds:
        if not 0 < f[0] < whole[0]:
            continue
        (_, m, c), (n, own, held) = _moments(whole - f, p), _moments(f, p)
        for i, a in enumerate(grid):
            w = lasso(c[:-1, :-1], c[:-1, -1], a, 500, 1e-7)
            gap = own[-1] - m[-1] - w @ (own[:-1] - m[:-1])
            error[i] += n * (held[-1, -1] - 2 * w @ held[:-1, -1] + w @ held[:-1, :-1] @ w + gap * gap)
    return lasso(cov[:-1, :-1], cov[:-1, -1], float(grid[error.argmin()]))


def stability_selection(rows: DataFrame, key: str, columns: list[str], target: str, draws: int = 50, fraction: float = 0.5, threshold: float = 0.6, folds: int = 5, alphas: int = 15, least: float = 1e-6, seed: int = 42) -> DataFrame:
    """(feature, probability, selected): the share of draws in which a cross-validated lasso of the target gives a column a
    coefficient over `least`. A row is in a draw if a hash of key and draw is under `fraction`, so rows of one key go together.
    Rows with a null or NaN are left out. Sums of draws by folds by columns squared are collected; each draw is fitted in a task."""
    p, spark = len(columns) + 1, rows.sparkSession
    real = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    fed = stored(rows.select(F.xxhash64(F.col(key), F.lit(seed)).alias("key"), F.array(*map(real, [*columns, target])).alias("x")).filter(~F.exists("x", lambda v: v.isNull())))
    centre = fed.agg(*(F.avg(F.get("x", F.lit(i))) for i in range(p))).first()
    centre = np.array([c or 0.0 for c in centre])
    size, limit = 1 + p + p * p, np.uint64(min(int(fraction * 2.0**64), 2**64 - 1))

    def add(total, b):
        keys, x = b.column(0).to_numpy(), matrix(b.column(1)) - centre
        table, fold = total.reshape(draws, folds, size), mixed(keys, draws) % np.uint64(folds)
        for m in range(draws):
            inside = mixed(keys, m) <= limit
            for f in range(folds):
                own = x[inside & (fold == f)]
                table[m, f] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])

    table = _summing(fed, draws * folds * size, add).reshape(draws, folds, size)
    dropped(fed)

    def fit(parts):
        for part in parts:
            kept = [np.abs(_fitted(table[m], p, alphas)) > least for m in part["id"]]
            yield part.assign(kept=[k.tolist() for k in kept]).drop(columns="id")

    each = spark.range(draws).repartition(min(draws, 200)).mapInPandas(fit, "kept array<boolean>")
    shares = each.agg(*(F.avg(F.col("kept")[i].cast("double")).alias(str(i)) for i in range(p - 1)))
    named = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(str(i)).alias("probability")) for i, c in enumerate(columns)))
    return shares.select(F.explode(named).alias("s")).select("s.*").withColumn("selected", F.col("probability") >= threshold)
