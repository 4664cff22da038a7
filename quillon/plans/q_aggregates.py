"""Aggregations over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.operators import meta as M
from quillon.registry import query
from quillon.sources.tables import table


def exposure_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, maximum and exceedances of each analyte at each site, with the site's place."""
    t = lambda n: table(spark, sf, n)
    limit = F.when(F.col("p_type") == "ECONOMY", 40.0).when(F.col("p_type") == "STANDARD", 45.0).otherwise(F.lit(float("inf")))
    sites = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    per = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.round(F.avg("l_quantity"), 6).alias("mean_value"), F.max("l_quantity").alias("max_value"), F.count_if(F.col("l_quantity") > limit).alias("exceedances"))
    return per.join(sites, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_suppkey").alias("site"), "n_name", "p_type", "mean_value", "max_value", "exceedances")


query(
    "A1_exposure_metrics",
    """SELECT l_suppkey AS site, n_name, p_type, round(avg(l_quantity), 6) AS mean_value, max(l_quantity) AS max_value, count(*) FILTER (WHERE l_quantity > CASE p_type WHEN 'ECONOMY' THEN 40 WHEN 'STANDARD' THEN 45 ELSE 'inf'::DOUBLE END) AS exceedances
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
)(exposure_metrics)


@query(
    "A2_site_parameter",
    """SELECT l_suppkey, l_returnflag, round(avg(l_extendedprice), 4) AS value_mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS value_median, max(l_extendedprice) AS value_max, count(*) AS value_count, min(l_shipdate) AS first_date, CASE WHEN l_returnflag IN ('A', 'R') THEN count(*) FILTER (WHERE l_extendedprice > 50000) END AS exceedances FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def a2(spark, sf):
    v = "l_extendedprice"
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.round(F.avg(v), 4).alias("value_mean"), F.round(S.median(v), 4).alias("value_median"), F.max(v).alias("value_max"), F.count(v).alias("value_count"), F.min("l_shipdate").alias("first_date"),
        F.when(F.col("l_returnflag").isin("A", "R"), F.count_if(F.col(v) > 50000)).alias("exceedances"),
    )


@query(
    "A3_longitudinal",
    """SELECT user_id, count(*) AS n, round(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / 365.25, 6) AS years, count(DISTINCT event_type) AS n_codes, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type = 'click') AS n_click, min(ts) AS first_ts FROM events GROUP BY 1""",
)
def a3(spark, sf):
    of = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.datediff(F.max("ts"), F.min("ts")) / 365.25, 6).alias("years"), F.count_distinct("event_type").alias("n_codes"), of("error").alias("n_error"), of("click").alias("n_click"), F.min("ts").alias("first_ts"))


@query("A4_trajectories", "SELECT user_id, event_type, min(ts) AS started, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE))::INT AS days, count(*) AS n, count(DISTINCT floor(value)) - 1 AS changes FROM events GROUP BY ALL")
def a4(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("started"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.count(F.lit(1)).alias("n"), (F.count_distinct(F.floor("value")) - 1).alias("changes"))


@query("A5_utilisation", "WITH p AS (SELECT o_custkey, count(*) n, CASE WHEN date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) = 0 THEN 1 ELSE date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25 END y FROM orders GROUP BY 1) SELECT c_custkey, round(n / y, 6) AS per_year FROM customer LEFT JOIN p ON o_custkey = c_custkey")
def a5(spark, sf):
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.count(F.lit(1)) / F.when(days == 0, 1.0).otherwise(days / 365.25), 6).alias("per_year"))
    return table(spark, sf, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "per_year")


@query(
    "A6_comorbidity_pairs",
    """WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority p FROM orders), n AS (SELECT count(DISTINCT o_custkey) n FROM orders), c AS (SELECT a.p || ' + ' || b.p AS pair, count(*) AS n_both FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.p < b.p GROUP BY 1)
SELECT pair, n_both, round(n_both / n::DOUBLE, 6) AS support FROM c, n WHERE n_both >= floor(0.05 * n)""",
)
def a6(spark, sf):
    d = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("p")).distinct()
    n = d.agg(F.count_distinct("o_custkey").alias("n"))
    pairs = d.join(d.select("o_custkey", F.col("p").alias("q")), "o_custkey").filter("p < q").groupBy(F.concat_ws(" + ", "p", "q").alias("pair")).agg(F.count(F.lit(1)).alias("n_both"))
    return pairs.crossJoin(F.broadcast(n)).filter(F.col("n_both") >= F.floor(F.col("n") * 0.05)).select("pair", "n_both", F.round(F.col("n_both") / F.col("n"), 6).alias("support"))


@query(
    "A7_daily_anomalies",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) s, avg(value) m, stddev_samp(value) sd FROM events GROUP BY 1), g AS (SELECT avg(s) gm, stddev_samp(s) gs FROM d) SELECT day, round(s, 4) AS total, round(m, 6) AS mean, round(sd, 6) AS std, abs(s - gm) > 2 * gs AS anomaly FROM d, g""",
)
def a7(spark, sf):
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("s"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))
    g = d.agg(F.avg("s").alias("gm"), F.stddev_samp("s").alias("gs"))
    return d.crossJoin(F.broadcast(g)).select("day", F.round("s", 4).alias("total"), "mean", "std", (F.abs(F.col("s") - F.col("gm")) > 2 * F.col("gs")).alias("anomaly"))


@query(
    "A8_cluster_summary",
    """WITH c AS (SELECT l_suppkey AS k, l_returnflag f, count(*) n FROM lineitem GROUP BY ALL), m AS (SELECT k, arg_max(f, (n, -ascii(f))) AS mode_flag, max(n) / sum(n) AS purity FROM c GROUP BY 1),
s AS (SELECT l_suppkey k, max(l_partkey) - min(l_partkey) AS span, avg(l_extendedprice) m, quantile_cont(l_extendedprice, 0.5) md, stddev_samp(l_extendedprice) sd, avg(l_discount) dm FROM lineitem GROUP BY 1)
SELECT k AS cluster, mode_flag, round(purity, 6) AS purity, span, round(m, 4) AS mean, round(md, 4) AS median, round(sd, 4) AS std, CASE WHEN dm > 0.0505 THEN 'risk' WHEN dm < 0.0495 THEN 'protective' ELSE 'neutral' END AS effect FROM m JOIN s USING (k)""",
)
def a8(spark, sf):
    l, v = table(spark, sf, "lineitem"), "l_extendedprice"
    flags = l.groupBy(F.col("l_suppkey").alias("cluster"), "l_returnflag").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("l_returnflag", F.struct("n", -F.ascii("l_returnflag"))).alias("mode_flag"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))
    d = F.avg("l_discount")
    stats = l.groupBy(F.col("l_suppkey").alias("cluster")).agg((F.max("l_partkey") - F.min("l_partkey")).alias("span"), F.round(F.avg(v), 4).alias("mean"), F.round(S.median(v), 4).alias("median"), F.round(F.stddev_samp(v), 4).alias("std"), F.when(d > 0.0505, "risk").when(d < 0.0495, "protective").otherwise("neutral").alias("effect"))
    return flags.join(stats, "cluster")


@query("A8_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, rk FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rk FROM lineitem) WHERE rk <= 5")
def a8b(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").withColumn("rk", F.row_number().over(w)).filter("rk <= 5").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rk").cast("long").alias("rk"))


@query("A9_registry_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a9(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.grouping_id().cast("long").alias("level"))


@query("A9_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def a9b(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("A10_catalog_stats", "SELECT count(*) AS n, coalesce(sum(CASE WHEN c_acctbal > 1e9 THEN c_acctbal END), 0) AS big, round(coalesce(sum(c_acctbal), 0), 2) AS total FROM customer")
def a10(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(b > 1e9, b)), F.lit(0.0)).alias("big"), F.round(F.coalesce(F.sum(b), F.lit(0.0)), 2).alias("total"))


@query("A11_cluster_profile", "SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, count(*) AS n FROM (SELECT label, embedding[1]::DOUBLE AS v FROM embeddings) GROUP BY 1")
def a11(spark, sf):
    q = lambda p: F.round(F.percentile("v", F.lit(p)), 6)
    return table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v")).groupBy("label").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.count(F.lit(1)).alias("n"))


@query("A12_pseudobulk", "SELECT user_id, event_type, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def a12(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query(
    "A13_alpha_diversity",
    """WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(-sum(p * ln(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson, count(*) AS richness, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS evenness FROM p GROUP BY 1""",
)
def a13(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).filter("p > 0")
    h, k = -F.sum(F.col("p") * F.log("p")), F.count(F.lit(1))
    return p.groupBy("user_id").agg(F.round(h, 6).alias("shannon"), F.round(1 - F.sum(F.col("p") * F.col("p")), 6).alias("simpson"), k.alias("richness"), F.round(F.when(k > 1, h / F.log(k)).otherwise(0.0), 6).alias("evenness"))


@query(
    "A14_mixture_index",
    """WITH v AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY ALL), r AS (SELECT *, (rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0) / count(*) OVER (PARTITION BY event_type) * 100 AS pct FROM v) SELECT user_id, round(avg(pct), 6) AS mixture FROM r GROUP BY 1""",
)
def a14(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    pct = S.average_rank(["event_type"], "x") / F.count(F.lit(1)).over(Window.partitionBy("event_type")) * 100
    return v.withColumn("pct", pct).groupBy("user_id").agg(F.round(F.avg("pct"), 6).alias("mixture"))


_WEIGHTS = {"click": (0.3, 20.0), "error": (0.4, 10.0), "purchase": (0.2, 30.0)}


@query(
    "A15_body_burden",
    """WITH w(event_type, w, hi) AS (VALUES ('click', 0.3, 20.0), ('error', 0.4, 10.0), ('purchase', 0.2, 30.0)), b AS (SELECT user_id, avg(w * value / hi) AS b FROM events JOIN w USING (event_type) GROUP BY 1)
SELECT user_id, round(b, 6) AS burden, CASE WHEN b < 0.2 THEN 'low' WHEN b < 0.4 THEN 'moderate' WHEN b < 0.6 THEN 'elevated' WHEN b < 0.8 THEN 'high' ELSE 'very_high' END AS category FROM b""",
)
def a15(spark, sf):
    w = spark.createDataFrame([(k, *v) for k, v in _WEIGHTS.items()], "event_type string, w double, hi double")
    per = table(spark, sf, "events").join(F.broadcast(w), "event_type").groupBy("user_id").agg(F.avg(F.col("w") * F.col("value") / F.col("hi")).alias("b"))
    b = F.col("b")
    return per.select("user_id", F.round("b", 6).alias("burden"), F.when(b < 0.2, "low").when(b < 0.4, "moderate").when(b < 0.6, "elevated").when(b < 0.8, "high").otherwise("very_high").alias("category"))


@query("A16_sum_detected", "SELECT user_id, round(sum(value) FILTER (WHERE event_type IN ('error', 'click') AND value > 50), 4) AS total, count(*) FILTER (WHERE event_type IN ('error', 'click') AND value > 50) AS n_detected FROM events GROUP BY 1")
def a16(spark, sf):
    hit = F.col("event_type").isin("error", "click") & (F.col("value") > 50)
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.when(hit, F.col("value"))), 4).alias("total"), F.count_if(hit).alias("n_detected"))


@query("A17_ratios", "WITH p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') a, avg(value) FILTER (WHERE event_type = 'error') b FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN b > 0 THEN a / b END, 6) AS click_error FROM p")
def a17(spark, sf):
    p = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.avg("value"))
    return p.select("user_id", F.round(F.when(F.col("error") > 0, F.col("click") / F.col("error")), 6).alias("click_error"))


@query("A18_capped_burden", "WITH s AS (SELECT l_orderkey, 0.3 * sum(l_quantity) / 100 + 0.25 * least(avg(l_extendedprice) / 10000, 1.0) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, round(b, 6) AS burden, CASE WHEN b > 0.7 THEN 'high' WHEN b > 0.4 THEN 'medium' ELSE 'low' END AS category FROM s")
def a18(spark, sf):
    # Air quality by 100, uncapped, weighs 0.3; releases by 10,000, capped at 1, weigh 0.25.
    b = 0.3 * F.sum("l_quantity") / 100 + 0.25 * F.least(F.avg("l_extendedprice") / 10000, F.lit(1.0))
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(b.alias("b"))
    return s.select("l_orderkey", F.round("b", 6).alias("burden"), F.when(F.col("b") > 0.7, "high").when(F.col("b") > 0.4, "medium").otherwise("low").alias("category"))


@query("A19_windowed_exposure", "SELECT user_id, round(avg(value) FILTER (WHERE hour(ts) < 8), 6) AS night_mean, max(value) FILTER (WHERE hour(ts) < 8) AS night_max, round(avg(value) FILTER (WHERE hour(ts) >= 8), 6) AS day_mean FROM events GROUP BY 1")
def a19(spark, sf):
    v, night = F.col("value"), F.hour("ts") < 8
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg(F.when(night, v)), 6).alias("night_mean"), F.max(F.when(night, v)).alias("night_max"), F.round(F.avg(F.when(~night, v)), 6).alias("day_mean"))


_STUDIES = "s AS (SELECT l_returnflag AS grp, l_suppkey AS study, avg(l_discount) AS e, stddev_samp(l_discount) / sqrt(count(*)) AS se, count(*) AS n FROM lineitem GROUP BY ALL)"


def _studies(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("study")).agg(F.avg("l_discount").alias("e"), (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n"))


_POOL = """, w AS (SELECT grp, e, 1 / (se * se) AS w FROM s WHERE se > 0), f AS (SELECT grp, sum(w) sw, sum(w * w) sww, sum(w * e) swe, sum(w * e * e) swee, count(*) k FROM w GROUP BY 1),
q AS (SELECT *, swe / sw AS fx, greatest(swee - swe * swe / sw, 0) AS q FROM f), t AS (SELECT *, CASE WHEN k > 1 THEN greatest((q - (k - 1)) / (sw - sww / sw), 0) ELSE 0 END AS tau2 FROM q)"""


@query(
    "A20_meta_analysis",
    f"WITH {_STUDIES}{_POOL}, r AS (SELECT w.grp, sum(1 / (1 / w + tau2)) rw, sum(e / (1 / w + tau2)) re FROM w JOIN t ON w.grp = t.grp GROUP BY 1) SELECT grp, k AS n_studies, round(fx, 6) AS fixed_effect, round(1 / sqrt(sw), 6) AS fixed_se, round(q, 3) AS q, round(CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q, 0) * 100 ELSE 0 END, 3) AS i2, round(tau2, 8) AS tau2, round(re / rw, 6) AS random_effect, round(re / rw - 1.96 / sqrt(rw), 6) AS ci_low, round(re / rw + 1.96 / sqrt(rw), 6) AS ci_high FROM t JOIN r USING (grp)",
)
def a20(spark, sf):
    m = M.meta_analysis(_studies(spark, sf), ["grp"], "e", "se")
    return m.select("grp", "n_studies", *(F.round(c, n).alias(c) for c, n in {"fixed_effect": 6, "fixed_se": 6, "q": 3, "i2": 3, "tau2": 8, "random_effect": 6, "ci_low": 6, "ci_high": 6}.items()))


@query("A21_federated_meta", f"WITH {_STUDIES}, w AS (SELECT study, e, 1 / (se * se) w FROM s WHERE se > 0), f AS (SELECT study, count(*) k, sum(w) sw, sum(w * e) / sum(w) fx, greatest(sum(w * e * e) - sum(w * e) * sum(w * e) / sum(w), 0) q FROM w GROUP BY 1) SELECT study, k AS n_sites, round(fx, 6) AS beta, round(1 / sqrt(sw), 6) AS se, round(greatest((q - (k - 1)) / sw, 0), 8) AS tau2 FROM f")
def a21(spark, sf):
    m = M.federated_meta(_studies(spark, sf), ["study"], "e", "se")
    return m.select("study", "n_sites", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round("tau2", 8).alias("tau2"))


@query("A22_federated_average", f"WITH {_STUDIES} SELECT grp, round(sum(n * e) / sum(n), 6) AS theta FROM s GROUP BY 1")
def a22(spark, sf):
    return M.weighted_average(_studies(spark, sf), ["grp"], "e", "n", "theta").withColumn("theta", F.round("theta", 6))


@query("A23_effect_size", "WITH x AS (SELECT label, embedding[3]::DOUBLE v FROM embeddings), g AS (SELECT label, count(*) n, avg(v) m, sum(v) s, sum(v * v) ss FROM x GROUP BY 1), t AS (SELECT sum(n) n, count(*) k, sum(s) / sum(n) gm, sum(ss) - sum(s) * sum(s) / sum(n) sst FROM g), b AS (SELECT sum(g.n * (m - gm) * (m - gm)) ssb FROM g, t) SELECT round(ssb / sst, 6) AS eta2, round((ssb / (k - 1)) / ((sst - ssb) / (n - k)), 4) AS f FROM t, b")
def a23(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.col("embedding")[2].cast("double").alias("v"))
    return M.eta_squared(x, "label", "v").select(F.round("eta2", 6).alias("eta2"), F.round("f", 4).alias("f"))


@query(
    "A24_cramers_v",
    """WITH c AS (SELECT c_mktsegment a, n_regionkey b, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT a, sum(n) ra FROM c GROUP BY 1), k AS (SELECT b, sum(n) cb FROM c GROUP BY 1), t AS (SELECT sum(n) t FROM c),
x AS (SELECT sum((coalesce(n, 0) - ra * cb / t) * (coalesce(n, 0) - ra * cb / t) / (ra * cb / t)) chi2 FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b))
SELECT round(chi2, 4) AS chi2, round(sqrt(chi2 / (t * least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM k) - 1))), 6) AS v FROM x, t""",
)
def a24(spark, sf):
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return M.cramers_v(x, "c_mktsegment", "n_regionkey").select(F.round("chi2", 4).alias("chi2"), F.round("v", 6).alias("v"))


@query(
    "A25_transition_matrix",
    """WITH l AS (SELECT user_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events) SELECT a AS source, b AS target, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM (SELECT a, b, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY a, b)""",
)
def a25(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    l = table(spark, sf, "events").select(F.lag("event_type").over(w).alias("source"), F.col("event_type").alias("target")).filter("source is not null")
    n = l.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query(
    "A26_stability",
    """WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) a FROM events), c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL)
SELECT user_id, round(max(n) / sum(n), 6) AS stability, any_value(t) AS transitions FROM c JOIN (SELECT user_id, count(*) FILTER (WHERE a <> event_type) t FROM l GROUP BY 1) USING (user_id) GROUP BY 1""",
)
def a26(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("a"))
    t = e.groupBy("user_id").agg(F.count_if(F.col("a") != F.col("event_type")).alias("transitions"))
    c = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("stability"))
    return c.join(t, "user_id")


@query(
    "A27_calibration",
    """WITH p AS (SELECT l_quantity / 50 AS p, (l_returnflag = 'R')::INT AS y FROM lineitem), b AS (SELECT least(greatest(floor(p * 10), 0), 9) AS bin, count(*) n, avg(p) mp, avg(y) my FROM p GROUP BY 1)
SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, round(max(abs(mp - my)), 6) AS mce, (SELECT round(avg((p - y) * (p - y)), 6) FROM p) AS brier FROM b""",
)
def a27(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return M.calibration(p, "p", "y").select(*(F.round(c, 6).alias(c) for c in ("ece", "mce", "brier")))


@query("A28_completeness", "SELECT o_orderkey, round(((o_totalprice > 100000)::INT + (o_custkey > 100)::INT + (o_orderstatus = 'F')::INT + (o_orderdate IS NOT NULL)::INT + (o_orderpriority LIKE '1%')::INT + (o_orderkey % 2 = 0)::INT) / 6.0, 6) AS score FROM orders")
def a28(spark, sf):
    flags = [F.col("o_totalprice") > 100000, F.col("o_custkey") > 100, F.col("o_orderstatus") == "F", F.col("o_orderdate").isNotNull(), F.col("o_orderpriority").startswith("1"), F.col("o_orderkey") % 2 == 0]
    return table(spark, sf, "orders").select("o_orderkey", F.round(sum((f.cast("int") for f in flags), F.lit(0)) / len(flags), 6).alias("score"))


@query("A29_imbalance", "WITH c AS (SELECT label, count(*) n FROM embeddings GROUP BY 1) SELECT round(min(n) / max(n), 6) AS ratio FROM c")
def a29(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").count().agg(F.round(F.min("count") / F.max("count"), 6).alias("ratio"))


@query("A30_value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def a30(spark, sf):
    return table(spark, sf, "events").dropna(subset=["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("A31_rubin_pooling", f"WITH {_STUDIES} SELECT grp, round(avg(e), 6) AS estimate, round(avg(se * se) + (1 + 1.0 / count(*)) * var_samp(e), 10) AS variance FROM s GROUP BY 1")
def a31(spark, sf):
    return M.rubin_pool(_studies(spark, sf), ["grp"], "e", "se").select("grp", F.round("estimate", 6).alias("estimate"), F.round("variance", 10).alias("variance"))


@query("A32_subgroup_meta", f"WITH {_STUDIES}, w AS (SELECT grp, e, 1 / (se * se) w FROM s WHERE se > 0) SELECT grp, count(*) AS n_studies, round(sum(w * e) / sum(w), 6) AS effect FROM w GROUP BY 1 HAVING count(*) >= 2")
def a32(spark, sf):
    m = M.meta_analysis(_studies(spark, sf), ["grp"], "e", "se").filter("n_studies >= 2")
    return m.select("grp", "n_studies", F.round("fixed_effect", 6).alias("effect"))
