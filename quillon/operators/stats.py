"""Statistical kernels from sums: tests, regression, batch correction, imputation, causal estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.functions import special


def standardise(long: DataFrame, feature: str, value: str, out: str = "z") -> DataFrame:
    """Population z-scores by feature; the moments are aggregated first, so a feature's rows need not meet in one task."""
    m = long.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s").isNull() | (F.col("_s") == 0), 1.0).otherwise(F.col("_s"))
    return long.join(m, feature).withColumn(out, z).drop("_m", "_s")


def welch(df: DataFrame, by: list[str], group: Column, value: str, least: int = 10) -> DataFrame:
    """Two groups compared by key: means, t, degrees of freedom, Cohen's d; groups under `least` rows are left out."""
    one, two = F.when(group, F.col(value)), F.when(~group, F.col(value))
    g = df.groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n0"), F.avg(one).alias("mean1"), F.avg(two).alias("mean0"), F.var_samp(one).alias("_v1"), F.var_samp(two).alias("_v0")).filter((F.col("n1") >= least) & (F.col("n0") >= least))
    a, b = F.col("_v1") / F.col("n1"), F.col("_v0") / F.col("n0")
    diff = F.col("mean1") - F.col("mean0")
    return g.select(*by, "n1", "n0", "mean1", "mean0", (diff / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("df"), (diff / F.sqrt((F.col("_v1") + F.col("_v0")) / 2)).alias("d"))


def with_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", special.t_p(F.col("t"), F.col("df")))


def kruskal(df: DataFrame, group: str, value: str, by: list[str]) -> DataFrame:
    """H without tie correction, and H / (n - 1), by key."""
    # Rows with one value share a rank, so only counts by value are ordered, not the rows.
    cell = df.groupBy(*by, value, group).agg(F.count(F.lit(1)).alias("_c"))
    tie = cell.groupBy(*by, value).agg(F.sum("_c").alias("_t"))
    rank = tie.withColumn("_r", F.sum("_t").over(Window.partitionBy(*by).orderBy(value)) - (F.col("_t") - 1) / 2).drop("_t")
    g = cell.join(rank, [*by, value]).groupBy(*by, group).agg(F.sum("_c").alias("_n"), F.sum(F.col("_r") * F.col("_c")).alias("_s"))
    n = F.sum("_n")
    h = 12 / (n * (n + 1)) * F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - 3 * (n + 1)
    return g.groupBy(*by).agg(h.alias("h"), (h / (n - 1)).alias("effect"))


def levene(df: DataFrame, group: str, value: str, by: list[str]) -> DataFrame:
    """Median-centred Levene W by key."""
    med = df.groupBy(*by, group).agg(S.median(value).alias("_m"))
    z = df.join(med, [*by, group]).withColumn("_z", F.abs(F.col(value) - F.col("_m")))
    g = z.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_z").alias("_s"), F.sum(F.col("_z") * F.col("_z")).alias("_q"))
    n, k = F.sum("_n"), F.count(F.lit(1))
    inside = F.sum(F.col("_s") * F.col("_s") / F.col("_n"))
    return g.groupBy(*by).agg((((n - k) * (inside - F.sum("_s") * F.sum("_s") / n)) / ((k - 1) * (F.sum("_q") - inside))).alias("w"))


def solve(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Cramer's rule for two or three normal equations."""

    def det(m):
        if len(m) == 1:
            return m[0][0]
        return reduce(lambda x, y: x + y, [(m[0][j] if j % 2 == 0 else -m[0][j]) * det([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))])

    d = det(a)
    return [det([[b[i] if j == c else a[i][j] for j in range(len(a))] for i in range(len(a))]) / d for c in range(len(a))]


def ols(df: DataFrame, by: list[str], y: str, xs: list[str], names: list[str]) -> DataFrame:
    """Least squares with intercept by key, from centred sums of products (up to three predictors)."""
    n, mean = F.count(F.lit(1)), {c: F.avg(c) for c in [y, *xs]}
    cov = lambda u, v: F.covar_pop(u, v) * n
    g = df.groupBy(*by).agg(n.alias("n"), *(m.alias(f"_m_{c}") for c, m in mean.items()), *(cov(u, v).alias(f"_c_{u}_{v}") for i, u in enumerate(xs) for v in xs[i:]), *(cov(x, y).alias(f"_c_{x}_{y}") for x in xs))
    at = lambda u, v: F.col(f"_c_{u}_{v}") if f"_c_{u}_{v}" in g.columns else F.col(f"_c_{v}_{u}")
    beta = solve([[at(u, v) for v in xs] for u in xs], [at(x, y) for x in xs])
    icept = F.col(f"_m_{y}") - reduce(lambda p, q: p + q, [b * F.col(f"_m_{x}") for b, x in zip(beta, xs, strict=True)])
    return g.select(*by, "n", icept.alias("intercept"), *(b.alias(nm) for b, nm in zip(beta, names, strict=True)))


def combat(long: DataFrame, feature: str, batch: str, value: str, out: str = "adjusted") -> DataFrame:
    """Location and scale batch correction with empirical-Bayes shrinkage of batch effects over features (closed form)."""
    c = F.col
    grand = long.groupBy(feature).agg(F.avg(value).alias("_a"))
    cell = long.groupBy(feature, batch).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    pooled = cell.groupBy(feature).agg((F.sum(c("_n") * c("_v")) / F.sum("_n")).alias("_s2"))
    z = cell.join(grand, feature).join(pooled, feature).withColumn("_sd", F.sqrt("_s2")).withColumn("_g", (c("_m") - c("_a")) / c("_sd")).withColumn("_d", c("_v") * c("_n") / F.greatest(c("_n") - 1, F.lit(1)) / c("_s2"))
    prior = z.groupBy(batch).agg(F.avg("_g").alias("_gb"), F.var_samp("_g").alias("_t2"), F.avg("_d").alias("_dm"), F.var_samp("_d").alias("_dv"))
    p = z.join(prior, batch)
    gamma = (c("_n") * c("_t2") * c("_g") + c("_d") * c("_gb")) / (c("_n") * c("_t2") + c("_d"))
    shape, rate = (2 * c("_dv") + c("_dm") * c("_dm")) / c("_dv"), (c("_dm") * c("_dv") + c("_dm") * c("_dm") * c("_dm")) / c("_dv")
    delta = (rate + 0.5 * (c("_n") - 1) * c("_d")) / (c("_n") / 2 + shape - 1)
    eff = p.select(feature, batch, "_a", "_sd", gamma.alias("_gs"), delta.alias("_ds"))
    return long.join(eff, [feature, batch]).withColumn(out, ((c(value) - c("_a")) / c("_sd") - c("_gs")) / F.sqrt("_ds") * c("_sd") + c("_a")).drop("_a", "_sd", "_gs", "_ds")


def variance_explained(long: DataFrame, feature: str, batch: str, value: str) -> DataFrame:
    """Between-batch share of each feature's sum of squares."""
    g = long.groupBy(feature, batch).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    base = F.sum("s") * F.sum("s") / F.sum("n")
    return g.groupBy(feature).agg(((F.sum(F.col("s") * F.col("s") / F.col("n")) - base) / (F.sum("q") - base)).alias("explained"))


def impute_median(long: DataFrame, feature: str, value: str) -> DataFrame:
    m = long.groupBy(feature).agg(S.median(value).alias("_m"))
    return long.join(m, feature).withColumn("imputed", F.coalesce(value, "_m")).drop("_m")


def wald_ratio(df: DataFrame, by: list[str], g: str, exposure: str, outcome: str) -> DataFrame:
    """Mendelian randomisation by one instrument: outcome slope over exposure slope, and the first stage's F."""
    bx, by_ = F.regr_slope(exposure, g), F.regr_slope(outcome, g)
    r2, n = F.regr_r2(exposure, g), F.count(F.lit(1))
    return df.groupBy(*by).agg((by_ / bx).alias("wald"), (r2 / (1 - r2) * (n - 2)).alias("f_stat"))


def mediation(df: DataFrame, by: list[str], x: str, m: str, y: str) -> DataFrame:
    """Baron-Kenny: total, direct and indirect (a * b) effects."""
    a = df.groupBy(*by).agg(F.regr_slope(m, x).alias("a"), F.regr_slope(y, x).alias("total"))
    b = ols(df, by, y, [x, m], ["direct", "b"]).select(*by, "direct", "b")
    return a.join(b, by).withColumn("indirect", F.col("a") * F.col("b"))


def conformal_quantile(df: DataFrame, error: str, alpha: float) -> DataFrame:
    """Half-width of a split-conformal interval: the ceil((n + 1)(1 - alpha)) / n quantile of absolute errors, at most 1."""
    n = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_q", F.least(F.ceil((F.col("_n") + 1) * (1 - alpha)) / F.col("_n"), F.lit(1.0)))
    q = n.first()["_q"]
    return df.agg(F.percentile(F.abs(error), F.lit(float(q))).alias("half_width"))


def stouffer(df: DataFrame, by: list[str], z: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(z) * F.col(weight)) / F.sqrt(F.sum(F.col(weight) * F.col(weight)))).alias("z"))


def correlations(long: DataFrame, entity: str, feature: str, value: str, least: int) -> DataFrame:
    """Pearson r of all feature pairs over the entities that have both."""
    a = long.select(entity, F.col(feature).alias("a"), F.col(value).alias("x"))
    b = long.select(entity, F.col(feature).alias("b"), F.col(value).alias("y"))
    return a.join(b, entity).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def detrend(df: DataFrame, by: list[str], time: str, value: str, batch: str) -> DataFrame:
    """Quadratic trend by least squares; batch means of the residuals removed; trend added back."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_t", F.col(time) - F.avg(time).over(w)).withColumn("_t2", F.pow(F.col(time) - F.avg(time).over(w), 2))
    fit = ols(d, by, value, ["_t", "_t2"], ["_b1", "_b2"]).drop("n")
    r = d.join(fit, by).withColumn("_trend", F.col("intercept") + F.col("_b1") * F.col("_t") + F.col("_b2") * F.col("_t2")).withColumn("_r", F.col(value) - F.col("_trend"))
    return r.withColumn("adjusted", F.col("_trend") + F.col("_r") - F.avg("_r").over(Window.partitionBy(*by, batch))).drop("_t", "_t2", "intercept", "_b1", "_b2", "_trend", "_r")


def explained_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, share, cumulative) of principal components. The moments, one row of len(columns) squared sums, are
    taken in Spark; their eigenvalues on the driver."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*(F.covar_samp(columns[i], columns[j]) for i, j in pairs)).first()
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row, strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    values = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
    share = values / (values.sum() or 1.0)
    return df.sparkSession.createDataFrame([(k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(share, np.cumsum(share), strict=True))], "component long, share double, cumulative double")


def correlation_edges(long: DataFrame, entity: str, feature: str, value: str, least: int = 10, strength: float = 0.3, alpha: float = 0.05) -> DataFrame:
    """Pairs of features that correlate by at least `strength` with p under alpha, from at least `least` shared entities."""
    c = correlations(long, entity, feature, value, least).filter(F.abs("r") >= strength)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return c.withColumn("p", special.t_p(t, (F.col("n") - 2).cast("double"))).filter(F.col("p") < alpha)


def sobel(df: DataFrame, by: list[str], x: str, m: str, y: str) -> DataFrame:
    """Sobel's z of the indirect effect of x on y through m: a * b by its standard error, from one pass of sums."""
    n, c = F.count(F.lit(1)), F.covar_pop
    g = df.groupBy(*by).agg(n.alias("n"), *(c(a, b).alias(k) for k, a, b in (("_xx", x, x), ("_mm", m, m), ("_yy", y, y), ("_xm", x, m), ("_xy", x, y), ("_my", m, y))))
    k = F.col
    a = k("_xm") / k("_xx")
    det = k("_xx") * k("_mm") - k("_xm") * k("_xm")
    b, direct = (k("_my") * k("_xx") - k("_xy") * k("_xm")) / det, (k("_xy") * k("_mm") - k("_my") * k("_xm")) / det
    rest_m = (k("_mm") - a * k("_xm")) * k("n") / (k("n") - 2)
    rest_y = (k("_yy") - b * k("_my") - direct * k("_xy")) * k("n") / (k("n") - 3)
    va, vb = rest_m / (k("n") * k("_xx")), rest_y * k("_xx") / (k("n") * det)
    return g.select(*by, a.alias("a"), b.alias("b"), (a * b).alias("indirect"), F.sqrt(a * a * vb + b * b * va).alias("se"), (a * b / F.sqrt(a * a * vb + b * b * va)).alias("z"))


def egger(df: DataFrame, by: list[str], exposure: str, outcome: str, se: str) -> DataFrame:
    """Egger regression of outcome effects on exposure effects over instruments, weighted by 1 / se**2, exposure effects
    made positive: slope (effect), intercept (directional pleiotropy) and the number of instruments; and the
    inverse-variance weighted estimate, which has no intercept."""
    sign = F.when(F.col(exposure) < 0, -1.0).otherwise(1.0)
    w, x, y = 1 / (F.col(se) * F.col(se)), F.abs(exposure), F.col(outcome) * sign
    d = df.select(*by, w.alias("_w"), x.alias("_x"), y.alias("_y"))
    s = lambda e: F.sum(e)
    w, x, y = F.col("_w"), F.col("_x"), F.col("_y")
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), s(w).alias("_sw"), s(w * x).alias("_sx"), s(w * y).alias("_sy"), s(w * x * x).alias("_xx"), s(w * x * y).alias("_xy"))
    k = F.col
    slope = (k("_sw") * k("_xy") - k("_sx") * k("_sy")) / (k("_sw") * k("_xx") - k("_sx") * k("_sx"))
    return g.select(*by, "n", slope.alias("slope"), ((k("_sy") - slope * k("_sx")) / k("_sw")).alias("intercept"), (k("_xy") / k("_xx")).alias("ivw"))


def impute_nearest(df: DataFrame, key: str, columns: list[str], donors: DataFrame, k: int = 5) -> DataFrame:
    """Missing values of df from the k nearest donors (a bounded reference table without missing values, at most
    100,000 rows): the distance is the root mean square over the columns that a row has, the value the donors' mean.
    A row without any value gets the donors' means."""
    import numpy as np
    import pyarrow as pa

    limit = 100_000
    known = donors.select(key, *columns).orderBy(key).limit(limit + 1).toPandas()
    if len(known) > limit:
        raise ValueError(f"over {limit} donors: sample them, or impute by groups")
    ref = known[columns].to_numpy(float)

    def fill(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if batch.num_rows else np.zeros((0, len(columns)))
            for i in np.flatnonzero(np.isnan(x).any(1)):
                has = ~np.isnan(x[i])
                near = np.argsort(np.sqrt(((ref[:, has] - x[i, has]) ** 2).mean(1)), kind="stable")[:k] if has.any() else np.arange(len(ref))
                x[i, ~has] = ref[near][:, ~has].mean(0)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(x[:, j]) for j in range(len(columns)))], names=[key, *columns])

    kind = dict(df.dtypes)[key]
    return df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(fill, f"{key} {kind}, " + ", ".join(f"{c} double" for c in columns))


def impute_chained(df: DataFrame, key: str, columns: list[str], rounds: int = 3, delta: float = 0.0, shifted: list[str] | None = None) -> DataFrame:
    """Multiple imputation's deterministic core, chained equations: missing values begin as means; in each round every
    column is regressed on the others over the rows that have it (sums in Spark, one row of coefficients) and predicted
    where it is missing. delta is added to the imputed values of `shifted` columns (not missing at random)."""
    import numpy as np

    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    now = df.select(key, *(F.col(c).cast("double").alias(f"_{c}") for c in columns)).withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit(means[c])) for c in columns})
    for _ in range(rounds):
        for c in columns:
            others = [o for o in columns if o != c]
            names = ["_one", *others, c]
            full = now.filter(F.col(f"_{c}").isNotNull()).withColumn("_one", F.lit(1.0))
            pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
            row = full.agg(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs)).first()
            s = np.zeros((len(names), len(names)))
            for (i, j), v in zip(pairs, row, strict=True):
                s[i, j] = s[j, i] = v or 0.0
            beta = np.linalg.lstsq(s[:-1, :-1], s[:-1, -1], rcond=None)[0]
            predicted = sum((F.col(o) * float(b) for o, b in zip(others, beta[1:], strict=True)), F.lit(float(beta[0])))
            now = now.withColumn(c, F.coalesce(F.col(f"_{c}"), predicted))
    shift = {c: F.when(F.col(f"_{c}").isNull(), F.col(c) + delta).otherwise(F.col(c)) for c in (shifted or [])}
    return (now.withColumns(shift) if shift else now).select(key, *columns)


def little_statistic(df: DataFrame, columns: list[str]) -> DataFrame:
    """Little's test that values are missing completely at random: (statistic, df, patterns). Patterns of missing
    columns, at most 2**len(columns), and their means are aggregated in Spark; means and covariances are those of the
    rows that have them."""
    import numpy as np

    flags = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns))
    rows = df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns)).collect()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    moments = df.agg(*(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i, j in pairs)).first()
    mean, cov = np.array([m or 0.0 for m in moments[: len(columns)]]), np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, moments[len(columns) :], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    stat, free = 0.0, -len(columns)
    for r in rows:
        at = [i for i, c in enumerate(r["pattern"]) if c == "0"]
        if at:
            d = np.array([r[columns[i]] for i in at]) - mean[at]
            stat, free = stat + r["n"] * float(d @ np.linalg.pinv(cov[np.ix_(at, at)]) @ d), free + len(at)
    return df.sparkSession.createDataFrame([(stat, free, len(rows))], "statistic double, df long, patterns long")
