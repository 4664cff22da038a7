"""Sparse models of many columns from sums over rows: graphical lasso, lasso and knockoffs.

One pass gives each fold's sums and products of columns, a table of folds by columns
squared. All penalties and folds are fitted from these in tasks of their own; rows
aren't read again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


class Moments:
    """Rows, means and centred covariances (over n) of columns, of all rows and of all but each fold; rows with a null
    or a NaN are left out. Folds go by a hash of the key."""

    def __init__(self, rows: DataFrame, key: str, columns: list[str], folds: int = 5, seed: int = 3):
        self.columns, p = columns, len(columns)
        fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")
        values = rows.select(fold.alias("fold"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))

        def summed(at: np.ndarray) -> np.ndarray:
            def sums(batches):
                total = np.zeros((folds, 1 + p + p * p))
                for b in batches:
                    f, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - at
                    f, x = f[(whole := ~np.isnan(x).any(1))], x[whole]
                    for k in np.unique(f):
                        own = x[f == k]
                        total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(list(range(folds)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["fold", "s"])

            parts = values.mapInArrow(sums, "fold int, s array<double>")
            out = np.zeros((folds, 1 + p + p * p))
            for r in parts.select("fold", F.posexplode("s").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v")).collect():  # folds times columns squared
                out[r["fold"], r["i"]] = r["v"]
            return out

        first = summed(np.zeros(p)).sum(0)
        at = first[1 : p + 1] / max(first[0], 1.0)
        table = summed(at)  # sums about the mean keep their digits
        self.folds, self.table, self.mean = folds, table, at

    def of(self, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, p = sums[0], len(self.columns)
        m = sums[1 : p + 1] / max(n, 1.0)
        return n, m, sums[p + 1 :].reshape(p, p) / max(n, 1.0) - np.outer(m, m)

    def whole(self):
        return self.of(self.table.sum(0))

    def split(self, fold: int):
        """The moments without a fold, and the fold's own."""
        return self.of(self.table.sum(0) - self.table[fold]), self.of(self.table[fold])


def soft(x, a):
    return np.sign(x) * np.maximum(np.abs(x) - a, 0.0)


def lasso(gram: np.ndarray, cross: np.ndarray, alpha: float, rounds: int = 2000, tol: float = 1e-9) -> np.ndarray:
    """The w that minimises w'Gw / 2 - c'w + alpha |w|, by coordinate descent."""
    w, residual = np.zeros(len(cross)), cross.astype(float).copy()
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            step = soft(residual[j] + gram[j, j] * w[j], alpha) / gram[j, j] - w[j]
            if step:
                w[j] += step
                residual -= gram[:, j] * step
                most = max(most, abs(step))
        if most < tol:
            break
    return w


def graphical_lasso(s: np.ndarray, alpha: float, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """The precision matrix that maximises log det T - tr(S T) - alpha |T off the diagonal| (Friedman et al. 2008): each
    column in turn is a lasso on the covariance of the others."""
    p = len(s)
    w, beta = s.copy(), np.zeros((p, p))
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            beta[rest, j] = lasso(w[np.ix_(rest, rest)], s[rest, j], alpha)
            w[rest, j] = w[j, rest] = w[np.ix_(rest, rest)] @ beta[rest, j]
        if np.abs(w - before).max() < tol:
            break
    out = np.zeros((p, p))
    for j in range(p):
        rest = np.arange(p) != j
        out[j, j] = 1 / (w[j, j] - w[rest, j] @ beta[rest, j])
        out[rest, j] = -beta[rest, j] * out[j, j]
    return (out + out.T) / 2


def _scored(spark: SparkSession, moments: Moments, alphas: list[float], fit) -> pd.DataFrame:
    """Mean of fit(alpha, training moments, held-out moments) over folds, for each alpha; a task for each pair."""
    pairs = spark.createDataFrame([(float(a), f) for a in alphas for f in range(moments.folds) if moments.table[f, 0] > 1], "alpha double, fold int")

    def run(parts):
        for part in parts:
            yield part.assign(score=[fit(a, *moments.split(f)) for a, f in zip(part["alpha"], part["fold"], strict=True)])

    return pairs.repartition(len(alphas)).mapInPandas(run, "alpha double, fold int, score double").groupBy("alpha").agg(F.avg("score").alias("score")).orderBy("alpha").toPandas()


def partial_correlations(rows: DataFrame, key: str, columns: list[str], alphas: list[float] | None = None, folds: int = 5, threshold: float = 0.01) -> DataFrame:
    """(feature_1, feature_2, correlation, partial_correlation, difference, is_direct, is_indirect, alpha) of all pairs of
    columns, from a graphical lasso of the penalty with the best held-out likelihood. Columns of one value have none."""
    spark, m = rows.sparkSession, Moments(rows, key, columns, folds)
    n, _, s = m.whole()
    schema = "feature_1 string, feature_2 string, correlation double, partial_correlation double, difference double, is_direct boolean, is_indirect boolean, alpha double"
    live = np.flatnonzero(np.diag(s) > 0)
    if n < 2 or len(live) < 2:
        return spark.createDataFrame([], schema)

    def likelihood(alpha, train, test):
        t = graphical_lasso(train[2][np.ix_(live, live)], alpha)
        sign, logdet = np.linalg.slogdet(t)
        return float(logdet - (test[2][np.ix_(live, live)] * t).sum()) if sign > 0 else -np.inf

    tried = _scored(spark, m, list(np.logspace(-3, 0, 20)) if alphas is None else alphas, likelihood)
    alpha = float(tried["alpha"][tried["score"].idxmax()])
    s = s[np.ix_(live, live)]
    t, sd = graphical_lasso(s, alpha), np.sqrt(np.diag(s))
    partial, plain, out = -t / np.sqrt(np.outer(np.diag(t), np.diag(t))), s / np.outer(sd, sd), []
    for i in range(len(live)):
        for j in range(i + 1, len(live)):
            c, q = float(plain[i, j]), float(partial[i, j])
            out.append((columns[live[i]], columns[live[j]], c, q, abs(c - q), abs(q) > threshold, abs(c) > 0.3 and abs(q) < threshold, alpha))
    return spark.createDataFrame(out, schema)


def knockoffs(rows: DataFrame, key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """rows with z_<i> and k_<i>: standardised columns and their equicorrelated Gaussian knockoffs, which have the same
    covariances but for each column's own. A row's noise is a hash of its key, so that a lost task's rows come back.
    Rows with a null in a column are left out."""
    m = Moments(rows, key, columns, 1)
    n, mean, cov = m.whole()
    p, sd = len(columns), np.sqrt(np.diag(cov))
    sd = np.where(sd > 0, sd, 1.0)
    mean = mean + m.mean
    sigma = cov / np.outer(sd, sd) * n / max(n - 1, 1)
    least = max(np.linalg.eigvalsh(sigma).min(), 1e-4) if n > 1 else 1e-4
    s = np.eye(p) * min(1.0, 2 * least)
    inverse = np.linalg.pinv(sigma)
    values, axes = np.linalg.eigh(2 * s - s @ inverse @ s)
    factor = axes * np.sqrt(np.maximum(values, 0.0))
    turn = np.eye(p) - inverse @ s
    kept, names = rows.columns, [f"{side}_{i}" for side in "zk" for i in range(p)]
    fed = rows.select(*kept, F.xxhash64(F.col(key), F.lit(seed)).alias("_hash"), F.array(*(F.col(c).cast("double") for c in columns)).alias("_x"))

    def drawn(batches):
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            whole = ~np.isnan(x).any(1)
            if whole.any():
                z, b = (x[whole] - mean) / sd, b.filter(pa.array(whole))
                own = z @ turn + normals(b.column("_hash").to_numpy(), p) @ factor.T
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, np.ascontiguousarray(np.hstack([z, own]).T))], names=[*kept, *names])

    return fed.mapInArrow(drawn, StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in names)]))


def normals(keys: np.ndarray, columns: int) -> np.ndarray:
    """Standard normal draws, a row for each 64-bit key: two hashes make one (Box and Muller)."""
    x = keys.view(np.uint64)[:, None] + (np.arange(2 * columns, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    unit = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54
    return np.sqrt(-2 * np.log(unit[:, ::2])) * np.cos(2 * np.pi * unit[:, 1::2])


def knockoff_statistics(rows: DataFrame, key: str, columns: list[str], target: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(feature, w): how much more a cross-validated lasso on columns and knockoffs weighs a column than its knockoff."""
    p = len(columns)
    names = [*(f"z_{i}" for i in range(p)), *(f"k_{i}" for i in range(p)), "_target"]
    m = Moments(knockoffs(rows, key, columns, seed).withColumn("_target", F.col(target).cast("double")), key, names, folds, seed)
    n, _, cov = m.whole()
    spark = rows.sparkSession
    if n < 2:
        return spark.createDataFrame([], "feature string, w double")

    def error(alpha, train, test):
        w = lasso(train[2][:-1, :-1], train[2][:-1, -1], alpha)
        gap = test[1][-1] - train[1][-1] - w @ (test[1][:-1] - train[1][:-1])
        return float(test[2][-1, -1] - 2 * w @ test[2][:-1, -1] + w @ test[2][:-1, :-1] @ w + gap * gap)

    most = float(np.abs(cov[:-1, -1]).max())
    tried = _scored(spark, m, list(np.logspace(np.log10(most) - 3, np.log10(most), 30)) if most > 0 else [0.0], error)
    w = np.abs(lasso(cov[:-1, :-1], cov[:-1, -1], float(tried["alpha"][tried["score"].idxmin()])))
    return spark.createDataFrame([(c, float(w[i] - w[p + i])) for i, c in enumerate(columns)], "feature string, w double")


def knockoff_select(statistics: DataFrame, fdr: float = 0.1) -> DataFrame:
    """(feature, w) of the features at or over the highest w whose estimated false discoveries, max(1, features at or
    under its negative) over those at or over it, are within fdr: the most stringent threshold that passes is taken."""
    both = statistics.select("feature", "w", F.col("w").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(statistics.select("feature", "w", (-F.col("w")).alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    above = Window.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # two rows a feature
    counted = both.withColumn("n", F.sum("up").over(above)).withColumn("false", F.greatest(F.lit(1), F.sum("down").over(above)))
    limit = counted.filter((F.col("up") == 1) & (F.col("false") <= F.col("n") * fdr)).agg(F.max("t").alias("t"))
    return statistics.crossJoin(F.broadcast(limit)).filter(F.col("w") >= F.col("t")).select("feature", "w")
