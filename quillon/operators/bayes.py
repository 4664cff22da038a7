"""A Bayesian mixture of Gaussians by variational updates from sums over rows.

Weights have a stick-breaking prior, means and precisions a normal-Wishart one
(Blei and Jordan 2006; Bishop 2006, 10.2), so that components that the data don't
need empty themselves. Each update is one pass in which tasks send a component's
rows, sums and products; the driver holds components times columns squared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.neighbours import matrix
from quillon.sources.shared import dropped, stored


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, x > 0: nine steps up, then the asymptotic series."""
    x, out = np.array(x, float), 0.0
    for _ in range(9):
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


_lgamma = np.vectorize(math.lgamma)


class Posterior:
    """The variational posterior of k components, from their rows (n), sums and products of rows."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, concentration: float, n: np.ndarray, sums: np.ndarray, products: np.ndarray):
        k, p = sums.shape
        self.m0, self.scale0, self.a0, self.nu0 = mean, cov, concentration, float(p)
        n = n + 1e-12
        at = sums / n[:, None]
        self.a, self.b = 1 + n, concentration + n.sum() - np.cumsum(n)
        self.beta, self.nu = 1.0 + n, p + n
        self.m = (mean + sums) / self.beta[:, None]
        gap = at - mean
        scatter = products - n[:, None, None] * at[:, :, None] * at[:, None, :]
        inverse = cov + scatter + (n / (1 + n))[:, None, None] * gap[:, :, None] * gap[:, None, :]
        self.inverse = (inverse + inverse.transpose(0, 2, 1)) / 2
        self.w = np.linalg.inv(self.inverse)
        both = digamma(self.a + self.b)
        left = digamma(self.b) - both
        self.log_weight = digamma(self.a) - both + np.concatenate([[0.0], np.cumsum(left)[:-1]])
        share = self.b / (self.a + self.b)
        self.weights = self.a / (self.a + self.b) * np.concatenate([[1.0], np.cumprod(share)[:-1]])
        self.weights /= self.weights.sum()
        i = np.arange(p)
        self.log_det = digamma((self.nu[:, None] - i) / 2).sum(1) + p * math.log(2) - np.linalg.slogdet(self.inverse)[1]

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """The expected log weight and density of each component at each row."""
        p = x.shape[1]
        out = np.empty((len(x), len(self.m)))
        for k in range(len(self.m)):
            gap = x - self.m[k]
            out[:, k] = self.log_weight[k] + 0.5 * (self.log_det[k] - p / self.beta[k] - self.nu[k] * np.einsum("ij,jk,ik->i", gap, self.w[k], gap) - p * math.log(2 * math.pi))
        return out

    def divergence(self) -> float:
        """Kullback-Leibler's of the posterior from the prior."""
        p, a, b, a0 = len(self.m0), self.a, self.b, self.a0
        sticks = -math.log(a0) - (_lgamma(a) + _lgamma(b) - _lgamma(a + b)) + (a - 1) * digamma(a) + (b - a0) * digamma(b) + (1 - a + a0 - b) * digamma(a + b)
        gap, i = self.m - self.m0, np.arange(p)
        means = 0.5 * p * (np.log(self.beta) + 1 / self.beta - 1) + 0.5 * self.nu * np.einsum("ki,kij,kj->k", gap, self.w, gap)
        psi, many = digamma((self.nu[:, None] - i) / 2).sum(1), lambda nu: _lgamma((np.asarray(nu)[..., None] - i) / 2).sum(-1)
        grown = np.linalg.slogdet(self.inverse)[1] - np.linalg.slogdet(self.scale0)[1]
        shapes = 0.5 * self.nu0 * grown + 0.5 * self.nu * (np.einsum("ij,kji->k", self.scale0, self.w) - p) + many(self.nu0) - many(self.nu) + 0.5 * (self.nu - self.nu0) * psi
        return float(sticks.sum() + means.sum() + shapes.sum())


def _soft(x: np.ndarray, posterior: Posterior) -> tuple[np.ndarray, np.ndarray]:
    logs = posterior.log_parts(x)
    most = logs.max(1, keepdims=True)
    total = most[:, 0] + np.log(np.exp(logs - most).sum(1))
    return np.exp(logs - total[:, None]), total


def _summed(rows: DataFrame, k: int, p: int, shares) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Each component's rows, sums and products by shares(batch) -> (share of each component, log likelihood)."""

    def sums(batches):
        n, s, q, total = np.zeros(k), np.zeros((k, p)), np.zeros((k, p, p)), 0.0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                r, logs = shares(b, x)
                n, s, total = n + r.sum(0), s + r.T @ x, total + logs.sum()
                q += np.stack([(x * r[:, j : j + 1]).T @ x for j in range(k)])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[total], n, s.ravel(), q.ravel()])], pa.list_(pa.float64()))], names=["s"])

    got = rows.mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + k + k * p + k * p * p)
    for r in got:
        flat[r["i"]] = r["v"]
    return flat[1 : k + 1], flat[k + 1 : k + 1 + k * p].reshape(k, p), flat[k + 1 + k * p :].reshape(k, p, p), flat[0]


def bayesian_mixture(points: DataFrame, key: str, vector: str, components: int = 10, concentration: float | None = None, rounds: int = 100, tol: float = 1e-3, seed: int = 42) -> tuple[DataFrame, dict]:
    """(key, cluster, probability) of every row with a key and a vector, and the model: `weights` of the components,
    `means`, `effective` (weights over 0.01) and `bound`, the evidence's lower bound a row after each update.

    Starts from k-means and ends when the bound rises by less than tol; concentration is 1 / components by default. Rows
    without a key or a vector are left out; an empty table gives no rows.
    """
    x = F.col(vector).cast("array<double>")
    rows = stored(points.select(F.col(key).cast("long").alias("key"), x.alias("x")).dropna())
    first = rows.first()
    if first is None:
        return rows.select("key", F.lit(0).alias("cluster"), F.lit(0.0).alias("probability")), {"weights": [], "means": [], "effective": 0, "bound": []}
    p, concentration = len(first["x"]), concentration or 1.0 / components
    near = rows.withColumn("features", array_to_vector("x"))
    start = stored(KMeans(k=components, seed=seed, maxIter=20).fit(near).transform(near).select("key", "x", "prediction"))

    def hard(b, x):
        r = np.zeros((b.num_rows, components))
        r[np.arange(b.num_rows), b.column("prediction").to_numpy()] = 1
        return r, np.zeros(b.num_rows)

    n, s, q, _ = _summed(start, components, p, hard)
    count = n.sum()
    mean = s.sum(0) / count
    cov = q.sum(0) / count - np.outer(mean, mean)
    cov = cov * count / max(count - 1, 1) + 1e-6 * np.eye(p)
    order = np.argsort(-n, kind="stable")  # sticks are broken in this order
    posterior, bound = Posterior(mean, cov, concentration, n[order], s[order], q[order]), []
    for _ in range(rounds):
        now = posterior
        n, s, q, total = _summed(rows, components, p, lambda b, x: _soft(x, now))  # noqa: B023
        bound.append((total - now.divergence()) / count)
        if len(bound) > 1 and bound[-1] - bound[-2] < tol:
            break
        posterior = Posterior(mean, cov, concentration, n, s, q)
    final = posterior

    def labelled(batches):
        for b in batches:
            if b.num_rows:
                r, _ = _soft(matrix(b.column("x")), final)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(r.argmax(1)), pa.array(r.max(1))], names=["key", "cluster", "probability"])

    dropped(start)
    out = rows.mapInArrow(labelled, "key long, cluster long, probability double")
    return out, {"weights": final.weights.tolist(), "means": final.m.tolist(), "effective": int((final.weights > 0.01).sum()), "bound": bound}
