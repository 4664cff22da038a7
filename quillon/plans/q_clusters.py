"""Density clustering, consensus, topology and imputation over the standard tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillon.operators import bayes as B
from quillon.operators import density as N
from quillon.operators import factors as FM
from quillon.operators import impute as I
from quillon.operators import manifold as D
from quillon.operators import stats as M
from quillon.registry import query
from quillon.sources.tables import table


LETTERS = "aehinoty"


def _letters(spark, sf):
    """Every document as a point: how many of a hundred of its characters are each of eight letters."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.lower("text").alias("t")).filter(F.length("t") > 0)
    share = lambda c: (F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c)))) * 100.0 / F.length("t")  # the letters are of one byte
    return d.select("doc_id", "lang", F.array(*map(share, LETTERS)).alias("x"))


_SQL_LETTERS = f"x AS (SELECT doc_id, lang, [(length(t) - length(replace(t, l, ''))) * 100.0 / length(t) FOR l IN {list(LETTERS)}]::DOUBLE[] AS x FROM (SELECT doc_id, lang, lower(text) AS t FROM documents) WHERE length(t) > 0)"


@query("M14_density_clusters")
def density(spark, sf):
    return N.density_clusters(_letters(spark, sf), "doc_id", "x", least=15, neighbours=5)


@query("M14_density_sweep")
def swept(spark, sf):
    return N.sweep(N.Cloud(_letters(spark, sf), "doc_id", "x", 10), least=(5, 15), neighbours=(5,))


@query("M14_density_consensus")
def agreed(spark, sf):
    cloud = N.Cloud(_letters(spark, sf), "doc_id", "x", 10)
    return N.consensus(cloud, N.sweep(cloud, least=(10, 15, 20), neighbours=(5,), methods=("eom",)), least=10)


@query("M19_topology")
def topology(spark, sf):
    """Gaps of the spanning tree, edges between languages, purity, and the spectrum of the neighbour graph, of all documents."""
    points = _letters(spark, sf)
    return N.topology(N.Cloud(points, "doc_id", "x", 10), points.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")), dims=6, rounds=12)


@query("M27_bootstrap_stability")
def stability(spark, sf):
    """How four centres of all documents come back in subsamples."""

    def four(points):
        rows = points.withColumn("features", array_to_vector("x"))
        return KMeans(k=4, seed=1).fit(rows).transform(rows).select("doc_id", F.col("prediction").alias("cluster"))

    return N.bootstrap_stability(_letters(spark, sf), "doc_id", four, draws=4)


@query(
    "M18_neighbour_purity",
    f"WITH {_SQL_LETTERS}, d AS (SELECT a.doc_id, a.lang AS l, b.lang AS m, row_number() OVER (PARTITION BY a.doc_id ORDER BY list_distance(a.x, b.x), b.doc_id) AS r FROM x a JOIN x b ON a.doc_id <> b.doc_id), p AS (SELECT doc_id, avg((l = m)::INT) AS p FROM d WHERE r <= 10 GROUP BY 1) SELECT round(avg(p), 3) AS purity FROM p",
)
def near_purity(spark, sf):
    """Exact ten nearest documents of every document: the share of the same language."""
    points = _letters(spark, sf)
    out = N.purity(N.nearest(N.Cells(points, "doc_id", "x", 10), 10), points.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")))
    return out.select(F.round("purity", 3).alias("purity"))


@query("M15_bayesian_mixture")
def mixture(spark, sf):
    """All documents by a mixture of at most eight Gaussians of their letters."""
    return B.bayesian_mixture(_letters(spark, sf), "doc_id", "x", 8, rounds=25)[0]


@query("M6_factor_model")
def factors(spark, sf):
    """Factors of all documents from two modalities: letters, and for those with lines the logarithms of their counts."""
    lines = table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 200, F.array(*(F.log1p(F.size(F.split("text", c)).cast("double")) for c in ("\n", "[.]", ",", " ")))).alias("counts"))
    rows = _letters(spark, sf).join(lines, "doc_id")
    return FM.factor_model(rows, "doc_id", {"x": len(LETTERS), "counts": 4}, 4, rounds=15)[0]


@query("M20_manifold_deviation")
def manifold(spark, sf):
    """Every document's deviation from the manifold of the English ones, and whether it passes the rotation null."""
    out = D.deviations(_letters(spark, sf), "doc_id", "x", F.col("lang") == "en", k=10, components=3)
    limit = D.rotation_threshold(out, "deviation", "key")
    return out.withColumn("deviant", F.col("deviation") > F.lit(limit))


def _holes(spark, sf):
    """Lines with a value left out in turn."""
    at = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10
    columns = {"q": F.col("l_quantity"), "p": F.col("l_extendedprice") / 1000, "d": F.col("l_discount") * 100}
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    return table(spark, sf, "lineitem").select(key, *(F.when(at != i, c).alias(n) for i, (n, c) in enumerate(columns.items())))


_SQL_HOLES = "h AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey * 7 + l_linenumber) % 10 AS hole, l_quantity AS q0, l_extendedprice / 1000 AS p0, l_discount * 100 AS d0 FROM lineitem), v AS (SELECT id, CASE WHEN hole <> 0 THEN q0 END AS q, CASE WHEN hole <> 1 THEN p0 END AS p, CASE WHEN hole <> 2 THEN d0 END AS d FROM h)"


@query(
    "M10_chained_equations",
    f"""WITH {_SQL_HOLES}, m AS (SELECT avg(q) AS mq, avg(p) AS mp FROM v), f AS (SELECT id, q, p, coalesce(q, mq) AS q1, coalesce(p, mp) AS p1 FROM v, m), a AS (SELECT regr_slope(q, p1) AS b, regr_intercept(q, p1) AS a FROM f WHERE q IS NOT NULL), g AS (SELECT id, p, coalesce(q, a + b * p1) AS q2 FROM f, a),
c AS (SELECT regr_slope(p, q2) AS b, regr_intercept(p, q2) AS a FROM g WHERE p IS NOT NULL) SELECT id, round(q2, 6) AS q, round(coalesce(p, a + b * q2), 6) AS p FROM g, c""",
)
def chained(spark, sf):
    """Two columns in one round, which SQL can repeat; operators' tests take more."""
    out = M.impute_chained(_holes(spark, sf), "id", ["q", "p"], rounds=1)
    return out.select("id", F.round("q", 6).alias("q"), F.round("p", 6).alias("p"))


@query("M10_nearest_rows")
def nearest(spark, sf):
    """The donors are a bounded sample of complete rows: those of the smallest keys' hashes."""
    h = _holes(spark, sf)
    donors = h.dropna().orderBy(F.xxhash64("id"), "id").limit(1000)
    return M.impute_nearest(h, "id", ["q", "p", "d"], donors, 5)


@query("M10_forest")
def forest(spark, sf):
    """All lines: missing quantities, prices and discounts (eleven values: a number, not a class) from forests."""
    return I.impute_forest(_holes(spark, sf), "id", ["q", "p", "d"], [], rounds=2, trees=10, depth=6)


@query("M10_multiple_imputation")
def pooled(spark, sf):
    """Means of five completed tables of all lines, pooled."""
    return I.pooled_means(I.impute_draws(_holes(spark, sf), "id", ["q", "p", "d"], 5, 3), ["q", "p", "d"])


@query("M10_little_test")
def little(spark, sf):
    return M.little_statistic(_holes(spark, sf), ["q", "p", "d"])
