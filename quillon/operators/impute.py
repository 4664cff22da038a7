"""Missing values from models of the other columns: rounds of forests, and seeded draws of chained equations.

Rows stay in Spark. The driver holds a column's forest, or a table of draws by columns
squared. All random numbers are hashes of a row's key, so that a task that runs again
draws the same values. NaN counts as missing, as NULL does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.sparse import normals
from quillon.sources.shared import dropped, stored


def _known(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def impute_forest(df: DataFrame, key: str, columns: list[str], categorical: list[str] | None = None, rounds: int = 10, trees: int = 100, depth: int = 8, tol: float = 1e-6, seed: int = 42) -> DataFrame:
    """(key, *columns) with missing values from forests (missForest).

    They begin as the column's mean, of `categorical` columns as the most frequent value (ties: the smallest); without a
    list, columns of fewer than ten distinct values are categorical. In each round, from the column with the fewest missing
    values on, a forest is fitted on all rows that have the column, with the other columns' present values, and predicts
    the rest. Rounds end once the mean squared change of imputed values is under tol, or when it grows: then the values of
    the round before are kept. A column without any value stays NULL and takes no part; so does a table without rows.
    """
    now = stored(df.select(key, *(_known(c).alias(f"_known_{c}") for c in columns)))
    stats = now.agg(F.count(F.lit(1)).alias("n"), *(F.count(f"_known_{c}").alias(f"n_{c}") for c in columns), *(F.avg(f"_known_{c}").alias(f"m_{c}") for c in columns), *(F.approx_count_distinct(f"_known_{c}").alias(f"d_{c}") for c in columns)).first()
    live = [c for c in columns if stats[f"n_{c}"]]
    kinds = set(categorical) if categorical is not None else {c for c in live if stats[f"d_{c}"] < 20 and now.select(f"_known_{c}").dropna().distinct().limit(10).count() < 10}
    holes = sorted((c for c in live if stats[f"n_{c}"] < stats["n"]), key=lambda c: (stats["n"] - stats[f"n_{c}"], columns.index(c)))
    levels, start = {}, {c: stats[f"m_{c}"] for c in live}
    for c in kinds & set(live):  # numbers of classes from 0, which a forest takes as labels
        counts = now.groupBy(F.col(f"_known_{c}").alias("v")).count().filter("v is not null").orderBy("v").collect()
        levels[c] = [r["v"] for r in counts]
        start[c] = max(counts, key=lambda r: (r["count"], -r["v"]))["v"]
    now = now.withColumns({c: F.coalesce(F.col(f"_known_{c}"), F.lit(start.get(c))) for c in columns})
    if len(live) < 2 or not holes:
        return now.select(key, *columns)
    before, last = stored(now), None
    for turn in range(rounds):
        now = before
        for c in holes:
            rows = now.withColumn("_model_x", array_to_vector(F.array(*(F.col(o) for o in live if o != c))))
            options = dict(featuresCol="_model_x", labelCol="_model_y", predictionCol="_model_p", numTrees=trees, maxDepth=depth, seed=seed)
            have = rows.filter(F.col(f"_known_{c}").isNotNull())
            if c in levels:
                values = F.array(*map(F.lit, levels[c]))
                if len(levels[c]) == 1:
                    continue
                fitted = RandomForestClassifier(**options, rawPredictionCol="_model_r", probabilityCol="_model_q").fit(have.withColumn("_model_y", (F.array_position(values, F.col(f"_known_{c}")) - 1).cast("double")))
                guess = F.get(values, F.col("_model_p").cast("int"))
            else:
                fitted = RandomForestRegressor(**options, featureSubsetStrategy="all").fit(have.withColumn("_model_y", F.col(f"_known_{c}")))
                guess = F.col("_model_p")
            now = fitted.transform(rows).withColumn(c, F.coalesce(F.col(f"_known_{c}"), guess)).select(before.columns)
        now = stored(now)
        old = before.select(key, *(F.col(c).alias(f"_old_{c}") for c in holes))
        gaps = now.join(old, key).agg(*(F.sum(F.when(F.col(f"_known_{c}").isNull(), (F.col(c) - F.col(f"_old_{c}")) ** 2)).alias(c) for c in holes)).first()
        change = sum(g or 0.0 for g in gaps) / sum(stats["n"] - stats[f"n_{c}"] for c in holes)
        if last is not None and change > last:
            dropped(now)
            break
        dropped(before)
        before, last = now, change
        if change < tol:
            break
    return before.select(key, *columns)


def _draws(keys: np.ndarray, draw: int, column: int, turn: int) -> np.ndarray:
    """A standard normal number for each 64-bit key."""
    mark = np.int64((draw * 1_000_003 + column * 1009 + turn) * 0x9E3779B1 % (1 << 62))
    return normals(keys ^ mark, 1)[:, 0]


def impute_draws(df: DataFrame, key: str, columns: list[str], draws: int = 5, rounds: int = 5, delta: float = 0.0, shifted: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(key, draw, *columns): `draws` completed tables by chained equations with their uncertainty, from draw 0.

    Every missing value begins as the column's mean. In each round each column with missing values is regressed on the
    others over the rows that have it; a coefficient vector and a residual variance are drawn from their posterior, and
    missing values are predictions plus a normal residual. All draws go together: a step is one pass in which tasks add
    up draws by columns squared. delta is added to the imputed values of `shifted` columns (not missing at random) after
    the last round. The key must be a number or a text, unique for draws to be independent between rows; rows of one key get the same
    residuals. A column without any value stays NULL and takes no part.
    """
    rng, p = np.random.default_rng(seed), len(columns)
    fed = stored(df.select(key, F.xxhash64(F.col(key), F.lit(seed)).alias("_hash"), F.array(*map(_known, columns)).alias("_x")))
    mean = fed.agg(*(F.avg(F.get("_x", F.lit(i))) for i in range(p)), *(F.count(F.get("_x", F.lit(i))) for i in range(p)), F.count(F.lit(1))).first()
    n = mean[2 * p]
    live = [j for j in range(p) if mean[p + j]]
    holes = [j for j in live if mean[p + j] < n]
    centre = np.array([mean[j] or 0.0 for j in range(p)])
    steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # round, column, coefficients by draw, residual spread by draw

    def filled(batch, done) -> tuple[np.ndarray, np.ndarray]:
        """Which values are missing, and rows by draw by column after the steps that are done, less the means."""
        x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        gone, keys = np.isnan(x), batch.column("_hash").to_numpy()
        full = np.repeat(np.where(gone, 0.0, x - centre)[:, None], draws, 1)
        for turn, j, beta, spread in done:
            at = np.flatnonzero(gone[:, j])
            for m in range(draws):
                full[at, m, j] = beta[m, 0] + full[at, m] @ beta[m, 1:] + spread[m] * _draws(keys[at], m, j, turn)
        return gone, full

    def gram(j: int, done) -> np.ndarray:
        """By draw, sums of products of one and all columns over the rows that have column j."""

        def sums(batches):
            total = np.zeros((draws, p + 1, p + 1))
            for b in batches:
                gone, full = filled(b, done)
                own = full[~gone[:, j]]
                one = np.concatenate([np.ones((*own.shape[:2], 1)), own], 2)
                total += np.einsum("rmi,rmk->mik", one, one)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

        out = np.zeros(draws * (p + 1) ** 2)
        parts = fed.select("_hash", "_x").mapInArrow(sums, "s array<double>")
        for r in parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():  # draws times columns squared
            out[r["i"]] = r["v"]
        return out.reshape(draws, p + 1, p + 1)

    for turn in range(rounds):
        for j in holes:
            others = [0, *(i + 1 for i in live if i != j)]
            table, beta, spread = gram(j, list(steps)), np.zeros((draws, p + 1)), np.zeros(draws)
            for m in range(draws):
                a, b, c = table[m][np.ix_(others, others)], table[m][others, j + 1], table[m][j + 1, j + 1]
                inverse = np.linalg.pinv(a, hermitian=True)
                w = inverse @ b
                free = max(table[m][0, 0] - len(others), 1.0)
                spread[m] = np.sqrt(max(c - w @ b, 0.0) / rng.chisquare(free))
                values, axes = np.linalg.eigh(inverse)
                beta[m, others] = w + spread[m] * (axes * np.sqrt(np.maximum(values, 0.0))) @ rng.standard_normal(len(others))
            steps.append((turn, j, beta, spread))
    moved = np.array([delta if shifted and c in shifted else 0.0 for c in columns])

    def complete(batches):
        for b in batches:
            gone, full = filled(b, steps)
            out = full + centre + (gone * moved)[:, None]
            out[:, :, [j for j in range(p) if j not in live]] = np.nan
            rows, flat = np.repeat(np.arange(b.num_rows), draws), out.reshape(-1, p)
            drawn = pa.array(np.tile(np.arange(draws, dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), drawn, *(pa.array(np.ascontiguousarray(flat[:, j]), from_pandas=True) for j in range(p))], names=[key, "draw", *columns])

    return fed.mapInArrow(complete, f"`{key}` {df.select(key).schema[0].dataType.simpleString()}, draw int, " + ", ".join(f"`{c}` double" for c in columns))


def pooled_means(drawn: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, estimate, within, between, variance, fraction) of the columns' means over the tables of impute_draws, by
    Rubin's rules: variance = within + (1 + 1 / draws) * between, and fraction is the part that missing values cause."""
    per = drawn.groupBy("draw").agg(*(F.avg(c).alias(c) for c in columns), *((F.var_samp(c) / F.count(c)).alias(f"_v_{c}") for c in columns))
    each = per.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("q"), F.col(f"_v_{c}").alias("u")) for c in columns))).alias("s")).select("s.*")
    g = each.groupBy("feature").agg(F.avg("q").alias("estimate"), F.avg("u").alias("within"), F.coalesce(F.var_samp("q"), F.lit(0.0)).alias("between"), F.count(F.lit(1)).alias("m"))
    out = g.withColumn("variance", F.col("within") + (1 + 1 / F.col("m")) * F.col("between"))
    return out.select("feature", "estimate", "within", "between", "variance", ((1 + 1 / F.col("m")) * F.col("between") / F.col("variance")).alias("fraction"))
