"""A factor model of several modalities with automatic relevance of factors.

Each row's factors are Gaussian given what is observed of it; loadings, noise and
relevance are set from sums over rows: one pass a round, in which tasks send columns
times factors squared. A missing modality, or value, is simply not observed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.neighbours import matrix
from quillon.sources.shared import stored


class Factors:
    """Loadings w (columns by factors), noise precisions tau by column, relevance alpha by factor."""

    def __init__(self, w: np.ndarray, tau: np.ndarray, alpha: np.ndarray):
        self.w, self.tau, self.alpha = w, tau, alpha

    def posterior(self, y: np.ndarray, seen: np.ndarray):
        """Of each row the factors' means and covariances, and the log likelihood of what is seen of it."""
        d, k = self.w.shape
        weight = seen * self.tau
        precision = np.eye(k) + (weight @ (self.w[:, :, None] * self.w[:, None, :]).reshape(d, k * k)).reshape(-1, k, k)
        cov = np.linalg.inv(precision)
        cross = (weight * y) @ self.w
        mean = np.einsum("nij,nj->ni", cov, cross)
        logs = -0.5 * (seen.sum(1) * np.log(2 * np.pi) - (seen * np.log(self.tau)).sum(1) + (weight * y * y).sum(1) - (mean * cross).sum(1) + np.linalg.slogdet(precision)[1])
        return mean, cov, logs


#: The Gamma prior of a factor's relevance: weak, so that data decide.
SHAPE, RATE = 1.0, 1e-3
#: The least variance of a column's noise, as a share of its variance.
LEAST_NOISE = 1e-6


def factor_model(rows: DataFrame, key: str, views: dict[str, int], factors: int = 10, rounds: int = 100, tol: float = 1e-5, seed: int = 42) -> tuple[DataFrame, dict]:
    """(key, factors) of every row with a key, and the model: by view the `loadings` (columns by factors) and `explained`
    (the share of variance by factor), the columns' `means` and `noise`, `alpha`, and `bound` by round: the log posterior
    of loadings, noise and relevance a row, which never falls.

    views: array columns and their lengths. A null array is a missing modality, a null or NaN in it a missing value; a
    row without any has factors 0. Columns are centred. Factors that the data don't need shrink towards 0. Ends when
    the bound rises by less than tol.
    """
    names, widths = list(views), list(views.values())
    d, k, ends = sum(widths), factors, np.concatenate([[0], np.cumsum(widths)])
    full = [F.coalesce(F.col(v).cast("array<double>"), F.array_repeat(F.lit(None).cast("double"), n)) for v, n in views.items()]
    held = stored(rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.concat(*full).alias("y")))

    def summed(size: int, each) -> np.ndarray:
        def sums(batches):
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    y = matrix(b.column("y"))
                    seen = ~np.isnan(y)
                    total += each(np.where(seen, y, 0.0), seen)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

        out = np.zeros(size)
        for r in held.mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    n = summed(2 * d, lambda y, seen: np.concatenate([seen.sum(0), y.sum(0)]))
    count, mean = n[:d], n[d:] / np.maximum(n[:d], 1)
    square = summed(d, lambda y, seen: (seen * (y - mean) ** 2).sum(0))
    variance = np.where(square > 0, square / np.maximum(count, 1), 1.0)
    total_rows = max(1, held.count())
    model = Factors(np.random.default_rng(seed).normal(0, 1, (d, k)) * np.sqrt(variance / k)[:, None], 1 / variance, np.ones(k))
    bound: list[float] = []
    for _ in range(rounds):
        now = model

        def each(y, seen, now=now):
            y = seen * (y - mean)
            m, cov, logs = now.posterior(y, seen)
            second = (m[:, :, None] * m[:, None, :] + cov).reshape(len(y), k * k)
            return np.concatenate([[logs.sum()], (y.T @ m).ravel(), (seen.T.astype(float) @ second).ravel()])

        got = summed(1 + d * k + d * k * k, each)
        prior = 0.5 * (d * np.log(now.alpha).sum() - (now.alpha * now.w**2).sum()) + (SHAPE * np.log(now.alpha) - RATE * now.alpha).sum()
        bound.append(float(got[0] + prior) / total_rows)
        if len(bound) > 1 and bound[-1] - bound[-2] < tol:
            break
        b, a = got[1 : 1 + d * k].reshape(d, k), got[1 + d * k :].reshape(d, k, k)
        w = np.linalg.solve(a * now.tau[:, None, None] + np.diag(now.alpha), (b * now.tau[:, None])[:, :, None])[:, :, 0]
        left = square - 2 * (w * b).sum(1) + np.einsum("di,dij,dj->d", w, a, w)
        tau = np.where(count > 0, np.maximum(count, 1) / np.maximum(left, LEAST_NOISE * variance * np.maximum(count, 1)), 1.0)
        model = Factors(w, tau, (0.5 * d + SHAPE) / (0.5 * (w**2).sum(0) + RATE))
    final = model

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column("y"))
                seen = ~np.isnan(y)
                m, _, _ = final.posterior(np.where(seen, y - mean, 0.0), seen)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(m), pa.list_(pa.float64()))], names=["key", "factors"])

    def residual(y, seen):
        y = seen * (y - mean)
        m, _, _ = final.posterior(y, seen)
        return np.concatenate([(seen * (y - m[:, [i]] * final.w[:, i]) ** 2).sum(0) for i in range(k)])

    rest = summed(k * d, residual).reshape(k, d)
    part = {v: slice(ends[i], ends[i + 1]) for i, v in enumerate(names)}
    explained = {v: [1 - float(rest[i, s].sum() / square[s].sum()) if square[s].sum() > 0 else 0.0 for i in range(k)] for v, s in part.items()}
    out = held.mapInArrow(placed, "key long, factors array<double>")
    return out, {"loadings": {v: final.w[s].tolist() for v, s in part.items()}, "explained": explained, "means": mean.tolist(), "noise": (1 / final.tau).tolist(), "alpha": final.alpha.tolist(), "bound": bound}
