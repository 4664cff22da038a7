"""Statistics, clusters, graphs and models over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.functions import special
from quillon.operators import cluster as K
from quillon.operators import graph as G
from quillon.operators import ranks as R
from quillon.operators import stats as M
from quillon.registry import query
from quillon.sources.tables import table


def _rounded(df, keys, places, *cols):
    return df.select(*keys, *(F.round(c, places).alias(c) for c in cols))


@query("M1_standardise", "SELECT event_id, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def m1(spark, sf):
    return _rounded(M.standardise(table(spark, sf, "events"), "event_type", "value"), ["event_id"], 6, "z")


@query(
    "M2_null_integration",
    """WITH a AS (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z FROM customer), o AS (SELECT o_custkey AS id, sum(o_totalprice) AS t FROM orders GROUP BY 1), b AS (SELECT id, (t - avg(t) OVER ()) / stddev_pop(t) OVER () AS z FROM o)
SELECT id, round(a.z * 0.3, 6) AS balance, round(b.z * 0.7, 6) AS spending FROM a FULL JOIN b USING (id)""",
)
def m2(spark, sf):
    def scaled(df, value, weight, name):
        m = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        return df.crossJoin(F.broadcast(m)).select("id", F.round((F.col(value) - F.col("_m")) / F.col("_s") * weight, 6).alias(name))

    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("t"))
    return scaled(a, "c_acctbal", 0.3, "balance").join(scaled(b, "t", 0.7, "spending"), "id", "outer")


@query(
    "M4_cosinor",
    """WITH x AS (SELECT event_type, value AS y, cos(2 * pi() * hour(ts) / 24) AS c, sin(2 * pi() * hour(ts) / 24) AS s FROM events), g AS (SELECT event_type, avg(y) my, avg(c) mc, avg(s) ms, covar_pop(c, c) cc, covar_pop(s, s) ss, covar_pop(c, s) cs, covar_pop(c, y) cy, covar_pop(s, y) sy FROM x GROUP BY 1), b AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS bc, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS bs FROM g)
SELECT event_type, round(my - bc * mc - bs * ms, 6) AS mesor, round(sqrt(bc * bc + bs * bs), 6) AS amplitude, round(my - bc * mc - bs * ms + bc * cos(2 * pi() * 9 / 24) + bs * sin(2 * pi() * 9 / 24), 6) AS at_nine FROM b""",
)
def m4(spark, sf):
    import math

    angle = 2 * math.pi * F.hour("ts") / 24
    x = table(spark, sf, "events").select("event_type", F.col("value").alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    f = M.ols(x, ["event_type"], "y", ["c", "s"], ["bc", "bs"])
    nine = 2 * math.pi * 9 / 24
    return f.select("event_type", F.round("intercept", 6).alias("mesor"), F.round(F.sqrt(F.col("bc") ** 2 + F.col("bs") ** 2), 6).alias("amplitude"), F.round(F.col("intercept") + F.col("bc") * math.cos(nine) + F.col("bs") * math.sin(nine), 6).alias("at_nine"))


@query(
    "M5_correlation_network",
    """WITH u AS (SELECT p_brand AS s, unnest(['l_discount', 'l_extendedprice', 'l_linenumber', 'l_orderkey', 'l_quantity', 'l_suppkey', 'l_tax', 'p_retailprice']) AS f, unnest([l_discount, l_extendedprice, l_linenumber, l_orderkey, l_quantity, l_suppkey, l_tax, p_retailprice]) AS x FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT s, f, avg(x) AS x FROM u GROUP BY ALL),
c AS (SELECT a.f AS a, b.f AS b, corr(a.x, b.x) AS r, count(*) AS n FROM m a JOIN m b ON a.s = b.s AND a.f < b.f GROUP BY ALL HAVING count(*) >= 10), t AS (SELECT *, abs(r) * sqrt((n - 2) / greatest(1 - r * r, 1e-300)) AS t, (n - 2)::DOUBLE AS v FROM c WHERE abs(r) >= 0.3),
g AS (SELECT *, unnest(range(4001)) AS i FROM t), p AS (SELECT a, b, any_value(r) AS r, any_value(n) AS n, greatest(0, 1 - 2 * exp(any_value(lgamma((v + 1) / 2) - lgamma(v / 2))) / sqrt(any_value(v) * pi()) * any_value(t) / 4000 / 3 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * i / 4000) * (t * i / 4000) / v, -(v + 1) / 2))) AS p FROM g GROUP BY a, b)
SELECT a, b, round(r, 6) AS r, n, round(p, 5) AS p FROM p WHERE p < 0.05""",
)
def m5(spark, sf):
    """Edges from |r| = .3 on with p < .05."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    long = S.long_form(lines, ["p_brand"], ["l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_quantity", "l_suppkey", "l_tax", "p_retailprice"])
    v = long.groupBy("p_brand", "feature").agg(F.avg("value").alias("x"))
    return M.correlation_edges(v, "p_brand", "feature", "x").select("a", "b", F.round("r", 6).alias("r"), "n", F.round("p", 5).alias("p"))


_SQL_T = """g AS (SELECT *, unnest(range(4001)) AS i FROM t), p AS (SELECT a, b, any_value(r) AS r, any_value(n) AS n, greatest(0, 1 - 2 * exp(any_value(lgamma((v + 1) / 2) - lgamma(v / 2))) / sqrt(any_value(v) * pi()) * any_value(t) / 4000 / 3 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * i / 4000) * (t * i / 4000) / v, -(v + 1) / 2))) AS p FROM g GROUP BY a, b)"""


@query(
    "M5_cross_modality",
    f"""WITH j AS (SELECT p_brand AS s, sum(l_extendedprice) AS e, avg(l_discount) AS d, sum(l_quantity) AS q, sum(l_tax) AS t, avg(p_retailprice) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), x AS (SELECT s, unnest(['price', 'discount']) AS a, round(unnest([e, d]), 5) AS x FROM j),
y AS (SELECT s, unnest(['quantity', 'tax', 'retail']) AS b, round(unnest([q, t, r]), 5) AS y FROM j), k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS y FROM x JOIN y USING (s)),
c AS (SELECT a, b, corr(x, y) AS r, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 10), t AS (SELECT *, abs(r) * sqrt((n - 2) / greatest(1 - r * r, 1e-300)) AS t, (n - 2)::DOUBLE AS v FROM c WHERE abs(r) >= 0.3),
{_SQL_T} SELECT a AS source, b AS target, round(r, 6) AS r, n, round(p, 5) AS p FROM p WHERE p < 0.05""",
)
def m5_cross(spark, sf):
    """Rank correlations over brands: turnover and mean discount against quantity, taxes and mean list price."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = lines.groupBy("p_brand").agg(*(F.round(f(c), 5).alias(n) for n, f, c in (("price", F.sum, "l_extendedprice"), ("discount", F.avg, "l_discount"), ("quantity", F.sum, "l_quantity"), ("tax", F.sum, "l_tax"), ("retail", F.avg, "p_retailprice"))))
    out = R.cross_edges(S.long_form(j, ["p_brand"], ["price", "discount"]), S.long_form(j, ["p_brand"], ["quantity", "tax", "retail"]), "p_brand", "feature", "value")
    return out.select("source", "target", F.round("r", 6).alias("r"), "n", F.round("p", 5).alias("p"))


@query("M10_median_imputation", "WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events), m AS (SELECT event_type, quantile_cont(v, 0.5) m FROM v GROUP BY 1) SELECT event_id, round(coalesce(v, m), 6) AS imputed FROM v JOIN m USING (event_type)")
def m10(spark, sf):
    v = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")).alias("v"))
    return _rounded(M.impute_median(v, "event_type", "v"), ["event_id"], 6, "imputed")


@query("M11_combat")
def m11(spark, sf):
    v = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row"), F.col("l_suppkey").alias("feature"), F.col("l_returnflag").alias("batch"), "l_extendedprice")
    return _rounded(M.combat(v, "feature", "batch", "l_extendedprice"), ["row", "feature"], 6, "adjusted")


@query("M13_batch_variance", "WITH g AS (SELECT l_suppkey f, l_returnflag b, count(*) n, sum(l_quantity) s, sum(l_quantity * l_quantity) q FROM lineitem GROUP BY ALL) SELECT f AS feature, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS explained FROM g GROUP BY 1")
def m13(spark, sf):
    return _rounded(M.variance_explained(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "feature"), "feature", "l_returnflag", "l_quantity"), ["feature"], 6, "explained")


_LONG = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY ALL)"


@query(
    "M26_validity",
    f"""WITH {_LONG}, d AS (SELECT sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(q) - sum(s * s / n) AS w, sum(n) AS n, count(*) AS k FROM c GROUP BY i), h AS (SELECT (sum(b) / (max(k) - 1)) / (sum(w) / (max(n) - max(k))) AS ch FROM d),
f AS (SELECT x.vec_id, x.label, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY ALL), s AS (SELECT label, avg(d) AS s FROM f GROUP BY 1), g AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL), r AS (SELECT g.a, max((sa.s + sb.s) / g) AS r FROM g JOIN s sa ON sa.label = g.a JOIN s sb ON sb.label = g.b GROUP BY 1)
SELECT round(ch, 4) AS calinski_harabasz, (SELECT round(avg(r), 5) FROM r) AS davies_bouldin FROM h""",
)
def m26(spark, sf):
    return K.validity(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query(
    "M26_silhouette",
    f"""WITH {_LONG}, d AS (SELECT x.vec_id, x.label, c.label AS k, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c ON x.i = c.i GROUP BY ALL), g AS (SELECT vec_id, label, min(d) FILTER (WHERE k = label) AS a, min(d) FILTER (WHERE k <> label) AS b FROM d GROUP BY ALL) SELECT label, round(avg((b - a) / greatest(a, b)), 5) AS silhouette, count(*) AS n FROM g GROUP BY 1""",
)
def m26b(spark, sf):
    s = K.simplified_silhouette(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return s.groupBy("label").agg(F.round(F.avg("silhouette"), 5).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query(
    "M27_adjusted_rand",
    """WITH n AS (SELECT label a, vec_id % 10 b, count(*) n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2.0) ij, sum(n) n FROM n), a AS (SELECT sum(m * (m - 1) / 2.0) s FROM (SELECT sum(n) m FROM n GROUP BY a)), b AS (SELECT sum(m * (m - 1) / 2.0) s FROM (SELECT sum(n) m FROM n GROUP BY b))
SELECT round((ij - a.s * b.s / (n * (n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (n * (n - 1) / 2.0)), 6)::DOUBLE AS ari FROM t, a, b""",
)
def m27(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).alias("other"))
    return K.adjusted_rand(e, "label", "other").select(F.round("ari", 6).alias("ari"))


@query("M27_nmi", "WITH n AS (SELECT label a, vec_id % 10 b, count(*)::DOUBLE n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n) t FROM n), j AS (SELECT -sum(n / t * ln(n / t)) h FROM n, t), a AS (SELECT -sum(m / t * ln(m / t)) h FROM (SELECT sum(n) m FROM n GROUP BY a), t), b AS (SELECT -sum(m / t * ln(m / t)) h FROM (SELECT sum(n) m FROM n GROUP BY b), t) SELECT round(2 * (a.h + b.h - j.h) / (a.h + b.h), 6) AS nmi FROM a, b, j")
def m27b(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).alias("other"))
    return K.normalised_mutual_information(e, "label", "other").select(F.round("nmi", 6).alias("nmi"))


@query("M22_knn", "WITH q AS (SELECT vec_id AS q, embedding AS x FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q, vec_id AS p, list_distance(x::DOUBLE[], embedding::DOUBLE[]) AS d FROM q, embeddings WHERE q <> vec_id) SELECT q, p, rank FROM (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY d, p) AS rank FROM d) WHERE rank <= 5")
def knn(spark, sf):
    e = table(spark, sf, "embeddings")
    return K.nearest_neighbours(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("q", "p", F.col("rank").cast("long").alias("rank"))


@query("M32_fisher_enrichment")
def m32(spark, sf):
    g = table(spark, sf, "part").select(F.col("p_brand").alias("set_id"), (F.col("p_size") > 40).alias("hit"))
    t = g.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    c = g.groupBy("set_id").agg(F.count_if("hit").alias("a"), F.count_if(~F.col("hit")).alias("b")).crossJoin(F.broadcast(t)).withColumns({"c": F.col("h") - F.col("a"), "d": F.col("n") - F.col("h") - F.col("b")})
    p = c.withColumn("p", special.fisher_p("a", "b", "c", "d")).withColumn("one", F.lit(1))
    return S.with_fdr(p, ["one"], "p", "set_id").select("set_id", "a", "b", "c", "d", "p", "q")


@query("M32_kruskal", "WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events), g AS (SELECT event_type, count(*) n, sum(r) s FROM r GROUP BY 1) SELECT round(12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1), 4) AS h FROM g")
def m32b(spark, sf):
    e = table(spark, sf, "events").withColumn("one", F.lit(1))
    return M.kruskal(e, "event_type", "value", ["one"]).select(F.round("h", 4).alias("h"))


@query("M34_stouffer", "WITH z AS (SELECT p_brand AS k, l_returnflag AS f, (avg(l_discount) - 0.05) * 1000 AS z, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT k AS pathway, round(sum(z * sqrt(n)) / sqrt(sum(n)), 5) AS z FROM z GROUP BY 1")
def m34(spark, sf):
    z = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("pathway"), "l_returnflag").agg(((F.avg("l_discount") - 0.05) * 1000).alias("zz"), F.sqrt(F.count(F.lit(1))).alias("w"))
    return _rounded(M.stouffer(z, ["pathway"], "zz", "w"), ["pathway"], 5, "z")


@query("M35_hubs", "WITH e AS (SELECT DISTINCT l_suppkey a, l_partkey b FROM lineitem), d AS (SELECT n AS node, count(*) AS degree FROM (SELECT a n FROM e UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY 1) SELECT node, degree FROM d WHERE degree >= (SELECT quantile_cont(degree, 0.9) FROM d)")
def m35(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return G.hubs(e, "a", "b", 0.9)


@query("M35_page_rank")
def m35b(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return G.page_rank(e, "a", "b", 5).select("node", F.round("rank", 8).alias("rank"))


@query(
    "M38_term_matching",
    """WITH t AS (SELECT p_partkey, lower(p_name) AS n FROM part), v AS (SELECT min(p_partkey) AS id, lower(p_name) AS n FROM part WHERE p_size < 10 GROUP BY 2), s AS (SELECT min(p_partkey) AS id, split_part(lower(p_name), ' ', 2) AS n FROM part WHERE p_size < 10 GROUP BY 2)
SELECT t.p_partkey, coalesce(v.id, s.id) AS concept, CASE WHEN v.id IS NOT NULL THEN 'exact' WHEN s.id IS NOT NULL THEN 'synonym' ELSE 'unmatched' END AS method FROM t LEFT JOIN v ON t.n = v.n LEFT JOIN s ON split_part(t.n, ' ', 2) = s.n""",
)
def m38(spark, sf):
    p = table(spark, sf, "part")
    n = F.lower("p_name")
    second = F.split_part(n, F.lit(" "), F.lit(2))
    exact = p.filter("p_size < 10").groupBy(n.alias("en")).agg(F.min("p_partkey").alias("exact"))
    syn = p.filter("p_size < 10").groupBy(second.alias("sn")).agg(F.min("p_partkey").alias("syn"))
    out = p.select("p_partkey", n.alias("n"), second.alias("s")).join(exact, F.col("n") == F.col("en"), "left").join(syn, F.col("s") == F.col("sn"), "left")
    return out.select("p_partkey", F.coalesce("exact", "syn").alias("concept"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("syn").isNotNull(), "synonym").otherwise("unmatched").alias("method"))


@query(
    "M39_mediation",
    """WITH d AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice / 1000 AS m, l_tax * 100 + l_extendedprice / 5000 AS y FROM lineitem), g AS (SELECT k, regr_slope(m, x) a, regr_slope(y, x) total, covar_pop(x, x) xx, covar_pop(m, m) mm, covar_pop(x, m) xm, covar_pop(x, y) xy, covar_pop(m, y) my FROM d GROUP BY 1), b AS (SELECT *, (xy * mm - my * xm) / (xx * mm - xm * xm) AS direct, (my * xx - xy * xm) / (xx * mm - xm * xm) AS b FROM g)
SELECT k, round(total, 6) AS total, round(direct, 6) AS direct, round(a * b, 6) AS indirect FROM b""",
)
def m39(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("m"), (F.col("l_tax") * 100 + F.col("l_extendedprice") / 5000).alias("y"))
    return _rounded(M.mediation(d, ["k"], "x", "m", "y"), ["k"], 6, "total", "direct", "indirect")


@query(
    "M39_sobel",
    """WITH d AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice / 1000 AS m, l_tax * 100 + l_extendedprice / 5000 AS y FROM lineitem), s AS (SELECT k, regr_slope(m, x) AS a, regr_intercept(m, x) AS a0, avg(x) AS mx FROM d GROUP BY 1), r AS (SELECT k, x, m, y, m - a0 - a * x AS mr, a, mx FROM d JOIN s USING (k)),
t AS (SELECT k, regr_slope(y, x) AS sy, regr_intercept(y, x) AS iy FROM d GROUP BY 1), q AS (SELECT r.*, y - iy - sy * x AS yr FROM r JOIN t USING (k)), b AS (SELECT k, any_value(a) AS a, regr_slope(yr, mr) AS b, count(*) AS n, sum(mr * mr) AS sm, sum((x - mx) * (x - mx)) AS sx, sum(yr * yr) AS sy FROM q GROUP BY 1)
SELECT k, round(a * b, 5) AS indirect, round(a * b / sqrt(a * a * ((sy - b * b * sm) / (n - 3) / sm) + b * b * (sm / (n - 2) / sx)), 3) AS z FROM b""",
)
def m39_sobel(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("m"), (F.col("l_tax") * 100 + F.col("l_extendedprice") / 5000).alias("y"))
    return M.sobel(d, ["k"], "x", "m", "y").select("k", F.round("indirect", 5).alias("indirect"), F.round("z", 3).alias("z"))


@query(
    "M41_egger",
    """WITH i AS (SELECT l_suppkey AS snp, avg(l_discount) - 0.05 AS x, avg(l_tax) - 0.04 AS y, stddev_samp(l_tax) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1 HAVING count(*) > 2), o AS (SELECT abs(x) AS x, y * CASE WHEN x < 0 THEN -1 ELSE 1 END AS y, 1 / (se * se) AS w FROM i),
m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM o), f AS (SELECT count(*) AS n, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope, sum(w * x * y) / sum(w * x * x) AS ivw FROM o, m) SELECT n, round(slope, 5) AS slope, round(my - slope * mx, 6) AS intercept, round(ivw, 5) AS ivw FROM f, m""",
)
def m41_egger(spark, sf):
    i = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") - 0.05).alias("x"), (F.avg("l_tax") - 0.04).alias("y"), (F.stddev_samp("l_tax") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("c")).filter("c > 2")
    return M.egger(i, [], "x", "y", "se").select("n", F.round("slope", 5).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("ivw", 5).alias("ivw"))


@query("M41_wald_ratio", "SELECT l_returnflag AS k, round(regr_slope(l_extendedprice, l_linenumber) / regr_slope(l_quantity, l_linenumber), 2) AS wald, round(regr_r2(l_quantity, l_linenumber) / (1 - regr_r2(l_quantity, l_linenumber)) * (count(*) - 2), 5) AS f_stat FROM lineitem GROUP BY 1")
def m41(spark, sf):
    w = M.wald_ratio(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "k"), ["k"], "l_linenumber", "l_quantity", "l_extendedprice")
    return w.select("k", F.round("wald", 2).alias("wald"), F.round("f_stat", 5).alias("f_stat"))


_TREE = "e AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"


@query("M43_ancestors", f"WITH RECURSIVE {_TREE}, a AS (SELECT c AS node, p AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.node, e.p, a.depth + 1 FROM a JOIN e ON a.ancestor = e.c) SELECT node, ancestor, depth FROM a")
def m43(spark, sf):
    n, s, r = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "region")
    tag = lambda t, c: F.concat(F.lit(t), F.col(c))
    e = n.select(tag("n", "n_nationkey").alias("c"), tag("r", "n_regionkey").alias("p")).unionAll(s.select(tag("s", "s_suppkey"), tag("n", "s_nationkey"))).unionAll(r.select(tag("r", "r_regionkey"), F.lit("world")))
    return G.closure(e, "c", "p")


@query("M45_levene", "WITH m AS (SELECT l_suppkey s, l_returnflag f, quantile_cont(l_quantity, 0.5) m FROM lineitem GROUP BY ALL), z AS (SELECT l_suppkey s, l_returnflag f, abs(l_quantity - m) z FROM lineitem JOIN m ON l_suppkey = s AND l_returnflag = f), g AS (SELECT s, f, count(*) n, sum(z) t, sum(z * z) q FROM z GROUP BY ALL) SELECT s, round((sum(n) - count(*)) * (sum(t * t / n) - sum(t) * sum(t) / sum(n)) / ((count(*) - 1) * (sum(q) - sum(t * t / n))), 5) AS w FROM g GROUP BY 1")
def m45(spark, sf):
    l = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s")
    return _rounded(M.levene(l, "l_returnflag", "l_quantity", ["s"]), ["s"], 5, "w")


@query("M48_cpm_log", "WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL) SELECT user_id, event_type, round(ln(1 + n / sum(n) OVER (PARTITION BY user_id) * 1e6), 6) AS log_cpm FROM c")
def m48(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.select("user_id", "event_type", F.round(F.log1p(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")) * 1e6), 6).alias("log_cpm"))


@query("M50_bray_curtis", "WITH c AS (SELECT user_id u, event_type t, count(*)::DOUBLE n FROM events GROUP BY ALL), s AS (SELECT u, sum(n) s FROM c GROUP BY 1), m AS (SELECT a.u x, b.u y, sum(least(a.n, b.n)) m FROM c a JOIN c b ON a.t = b.t AND a.u <> b.u WHERE a.u % 100 = 0 GROUP BY ALL) SELECT x, y, round(1 - 2 * m / (a.s + b.s), 6) AS distance FROM m JOIN s a ON a.u = x JOIN s b ON b.u = y")
def m50(spark, sf):
    """A query set (every hundredth user) against all."""
    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return K.bray_curtis(c, F.col("u") % 100 == 0).select("x", "y", F.round("distance", 6).alias("distance"))


@query("M54_conformal", "WITH e AS (SELECT list_sort(list(abs(l_quantity - 25))) AS e, least(ceil((count(*) + 1) * 0.9) / count(*), 1.0) AS q, count(*) AS n FROM lineitem), p AS (SELECT *, q * (n - 1) AS pos FROM e) SELECT round(e[floor(pos)::BIGINT + 1] + (pos - floor(pos)) * (e[least(floor(pos)::BIGINT + 2, n)] - e[floor(pos)::BIGINT + 1]), 3) AS half_width FROM p")
def m54(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_quantity") - 25).alias("e"))
    return M.conformal_quantile(e, "e", 0.1).select(F.round("half_width", 3).alias("half_width"))


@query("M64_lineage", f"WITH RECURSIVE {_TREE}, a AS (SELECT c, p, 1 AS depth FROM e WHERE c = 's7' UNION ALL SELECT e.c, e.p, depth + 1 FROM a JOIN e ON e.c = a.p) SELECT p AS ancestor, depth FROM a")
def m64(spark, sf):
    return m43(spark, sf).filter("node = 's7'").select("ancestor", "depth")


@query(
    "M66_group_comparison",
    """WITH g AS (SELECT l_suppkey AS k, count(*) FILTER (WHERE l_returnflag = 'R') n1, count(*) FILTER (WHERE l_returnflag <> 'R') n0, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') m1, avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') m0, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') v1, var_samp(l_quantity) FILTER (WHERE l_returnflag <> 'R') v0 FROM lineitem GROUP BY 1)
SELECT k, n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS t, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS d FROM g WHERE n1 >= 10 AND n0 >= 10""",
)
def m66(spark, sf):
    w = M.welch(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], F.col("l_returnflag") == "R", "l_quantity")
    return w.select("k", "n1", "n0", F.round("t", 5).alias("t"), F.round("d", 6).alias("d"))


@query("M66_welch_p")
def m66b(spark, sf):
    return M.with_p(M.welch(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], F.col("l_returnflag") == "R", "l_quantity"))


@query("M68_multilayer_degree", "WITH e AS (SELECT DISTINCT l_suppkey a, l_partkey b, l_returnflag y FROM lineitem), d AS (SELECT n AS node, count(*) AS degree FROM (SELECT a n FROM e UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY 1) SELECT node, degree FROM d")
def m68(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag").distinct()
    return G.degrees(e, "a", "b")


@query("M68_multilayer_hubs", "WITH e AS (SELECT DISTINCT l_suppkey a, l_partkey b, l_returnflag y FROM lineitem), d AS (SELECT n AS node, count(*) AS degree FROM (SELECT a n FROM e UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY 1) SELECT node, degree FROM d WHERE degree >= (SELECT quantile_cont(degree, 0.9) FROM d)")
def m68_hubs(spark, sf):
    """The nodes whose degree over all layers is at the ninetieth percentile or over it."""
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag").distinct()
    return G.hubs(e, "a", "b", 0.9)


@query("M69_patient_risk", "WITH z AS (SELECT user_id, abs(value - avg(value) OVER w) / stddev_pop(value) OVER w > 2 AS hi FROM events WINDOW w AS (PARTITION BY event_type)) SELECT user_id, round(avg(hi::INT), 6) AS share, CASE WHEN avg(hi::INT) > 0.7 THEN 'high' WHEN avg(hi::INT) > 0.4 THEN 'moderate' ELSE 'low' END AS risk FROM z GROUP BY 1")
def m69(spark, sf):
    z = M.standardise(table(spark, sf, "events"), "event_type", "value")
    share = F.avg((F.abs("z") > 2).cast("int"))
    return z.groupBy("user_id").agg(F.round(share, 6).alias("share"), F.when(share > 0.7, "high").when(share > 0.4, "moderate").otherwise("low").alias("risk"))


@query("M70_trend_preserving")
def m70(spark, sf):
    d = table(spark, sf, "events").select("event_id", "event_type", "value", (F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400.0 - 19723).alias("t"), (F.col("user_id") % 3).alias("batch"))
    return _rounded(M.detrend(d, ["event_type"], "t", "value", "batch"), ["event_id"], 6, "adjusted")


@query("M72_priority_score", "SELECT p_partkey, 3 * (p_size > 25)::INT + 2 * (p_retailprice > 1000)::INT + 2 * (p_type = 'ECONOMY')::INT AS priority FROM part")
def m72(spark, sf):
    flag = lambda c, w: c.cast("int") * w
    return table(spark, sf, "part").select("p_partkey", (flag(F.col("p_size") > 25, 3) + flag(F.col("p_retailprice") > 1000, 2) + flag(F.col("p_type") == "ECONOMY", 2)).alias("priority"))


@query("M76_download_queue", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 3 ELSE 2 END, o_orderkey LIMIT 50")
def m76(spark, sf):
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in {"1-URGENT": 0, "2-HIGH": 1, "5-LOW": 3}.items() for x in kv))[F.col("o_orderpriority")], F.lit(2))
    return table(spark, sf, "orders").orderBy(rank, "o_orderkey").limit(50).select("o_orderkey")


@query("M3_pca")
def m3(spark, sf):
    """Principal components of the embeddings; the data are centred first."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(e).transform(e)
    p = PCA(k=3, inputCol="c", outputCol="p").fit(centred).transform(centred).select("vec_id", vector_to_array("p").alias("p"))
    return p.select("vec_id", *(F.abs(F.round(F.col("p")[i], 6)).alias(f"abs_pc{i + 1}") for i in range(3)))


@query("M15_mixture_clusters")
def m15(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=10, seed=7).fit(e).transform(e).select("vec_id", "label", F.col("prediction").alias("cluster"))


@query("M23_merge_small", f"WITH {_LONG}, z AS (SELECT label, max(n) AS n FROM c GROUP BY 1), d AS (SELECT a.label a, b.label b, sum((a.m - b.m) * (a.m - b.m)) d FROM c a JOIN c b ON a.i = b.i WHERE a.n < 50 AND b.n >= 50 GROUP BY ALL), t AS (SELECT a, arg_min(b, (d, b)) AS b FROM d GROUP BY 1) SELECT vec_id, coalesce(b, label) AS merged FROM embeddings LEFT JOIN t ON label = a")
def m23(spark, sf):
    return K.merge_small(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 50).select("vec_id", "merged")
