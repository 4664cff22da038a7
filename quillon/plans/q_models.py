"""Domain models over the standard tables: cohorts, validation, targets, trials, preprocessing reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.operators import joins as J
from quillon.operators import nulls
from quillon.operators import signals
from quillon.operators import stats as M
from quillon.registry import query
from quillon.sources.tables import table


@query("J7_compare_tests", "WITH a AS (SELECT l_partkey k, avg(l_discount) v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey k, avg(l_tax) v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT coalesce(a.k, b.k) AS snp, CASE WHEN coalesce(a.v < 0.05, false) AND coalesce(b.v < 0.04, false) THEN 'both' WHEN coalesce(a.v < 0.05, false) THEN 'vqtl' WHEN coalesce(b.v < 0.04, false) THEN 'mqtl' ELSE 'none' END AS class FROM a FULL JOIN b ON a.k = b.k")
def j7(spark, sf):
    l = table(spark, sf, "lineitem")
    a = l.filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("snp")).agg((F.avg("l_discount") < 0.05).alias("x"))
    b = l.filter("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("snp")).agg((F.avg("l_tax") < 0.04).alias("y"))
    return a.join(b, "snp", "outer").fillna(False).select("snp", F.when(F.col("x") & F.col("y"), "both").when(F.col("x"), "vqtl").when(F.col("y"), "mqtl").otherwise("none").alias("class"))


@query("J4_left_metrics", "SELECT s_suppkey, a.n AS n_high, b.n AS n_low FROM supplier LEFT JOIN (SELECT l_suppkey k, count(*) n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a ON s_suppkey = a.k LEFT JOIN (SELECT l_suppkey k, count(*) n FROM lineitem WHERE l_quantity < 2 GROUP BY 1) b ON s_suppkey = b.k")
def j4(spark, sf):
    q = F.col("l_quantity")
    per = table(spark, sf, "lineitem", (q > 49) | (q < 2)).groupBy("l_suppkey").agg(F.count(F.when(q > 49, 1)).alias("h"), F.count(F.when(q < 2, 1)).alias("l"))
    out = table(spark, sf, "supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("s_suppkey", F.nullif("h", F.lit(0)).alias("n_high"), F.nullif("l", F.lit(0)).alias("n_low"))


@query("J13_inner_index", "SELECT e.vec_id, d.lang, e.label FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def j13(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label").join(table(spark, sf, "documents").select("doc_id", "lang"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "lang", "label")


@query("M7_site_correction", "WITH s AS (SELECT l_suppkey k, avg(l_quantity) m FROM lineitem GROUP BY 1), g AS (SELECT avg(m) gm FROM s) SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - 0.5 * (m - gm), 6) AS corrected FROM lineitem JOIN s ON l_suppkey = k, g")
def m7(spark, sf):
    l = table(spark, sf, "lineitem")
    s = l.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"))
    g = s.agg(F.avg("m").alias("gm"))
    return l.join(s, "l_suppkey").crossJoin(F.broadcast(g)).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") - 0.5 * (F.col("m") - F.col("gm")), 6).alias("corrected"))


@query("M12_residualise", "WITH b AS (SELECT l_suppkey k, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - a - b * l_quantity, 4) AS residual FROM lineitem JOIN b ON l_suppkey = k")
def m12(spark, sf):
    l = table(spark, sf, "lineitem")
    b = M.ols(l, ["l_suppkey"], "l_extendedprice", ["l_quantity"], ["b"])
    return l.join(b, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") - F.col("intercept") - F.col("b") * F.col("l_quantity"), 4).alias("residual"))


@query("M17_permutation_test")
def m17(spark, sf):
    """Balances of one segment against all others: the difference of means among 200 permutations of the labels."""
    c = table(spark, sf, "customer").select("c_custkey", F.array("c_acctbal").alias("x"), (F.col("c_mktsegment") == "BUILDING").alias("g")).filter("x[0] is not null")
    out = nulls.permutation_test(c, "c_custkey", "x", "g", lambda n, s, q: float(s[1, 0] / n[1] - s[0, 0] / n[0]), 200, two_sided=True)
    return out.select("observed", "p")


@query("M17_gap_statistic")
def m17_gap(spark, sf):
    """Labels of all embeddings against uniform references."""
    return nulls.gap_statistic(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 4)


@query("M17_sigclust")
def m17_gaussian(spark, sf):
    """Labels of all embeddings against clusters of one Gaussian."""
    return nulls.sigclust(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 5)


@query("M21_gower", "WITH r AS (SELECT max(p_size) - min(p_size) AS rs, max(p_retailprice) - min(p_retailprice) AS rp FROM part), d AS (SELECT a.p_partkey AS i, b.p_partkey AS j, round((abs(a.p_size - b.p_size) / rs + abs(a.p_retailprice - b.p_retailprice) / rp + (a.p_type <> b.p_type)::INT) / 3, 6) AS distance FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND a.p_partkey % 100 = 0, r) SELECT i, j, distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS k FROM d) WHERE k <= 5")
def m21(spark, sf):
    """The five nearest by mixed-type distance, for every hundredth part against all."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    r = p.agg((F.max("p_size") - F.min("p_size")).alias("rs"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("rp"))
    a, b = p.filter("p_partkey % 100 = 0").toDF("i", "si", "pi", "ti"), p.toDF("j", "sj", "pj", "tj")
    d = (F.abs(F.col("si") - F.col("sj")) / F.col("rs") + F.abs(F.col("pi") - F.col("pj")) / F.col("rp") + (F.col("ti") != F.col("tj")).cast("int")) / 3
    near = a.crossJoin(b).filter("i <> j").crossJoin(F.broadcast(r)).select("i", "j", F.round(d, 6).alias("distance"))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))).filter("k <= 5").drop("k")


@query("M24_double_holdout", "SELECT CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'holdout1' ELSE 'holdout2' END AS split, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def m24(spark, sf):
    k = F.col("o_orderkey") % 10
    return table(spark, sf, "orders").groupBy(F.when(k < 6, "train").when(k < 8, "holdout1").otherwise("holdout2").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("M28_leave_site_out", "WITH s AS (SELECT l_suppkey k, sum(l_quantity) s, count(*) n FROM lineitem GROUP BY 1), t AS (SELECT sum(s) ts, sum(n) tn FROM s) SELECT k AS site, round(s / n, 6) AS inside, round((ts - s) / (tn - n), 6) AS outside FROM s, t")
def m28(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    t = s.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return s.crossJoin(F.broadcast(t)).select("site", F.round(F.col("s") / F.col("n"), 6).alias("inside"), F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 6).alias("outside"))


@query("M30_calibration_slope", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity * 1000), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity * 1000), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def m30(spark, sf):
    q = F.col("l_quantity") * 1000
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", q), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", q), 2).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("M31_ancestry_specific", "WITH c AS (SELECT c_mktsegment AS cluster, n_regionkey AS ancestry, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT cluster, arg_max(ancestry, (n, -ancestry)) AS main, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) > 0.8 AS specific FROM c GROUP BY 1")
def m31(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("cluster"), "n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return c.groupBy("cluster").agg(F.max_by("n_regionkey", F.struct("n", -F.col("n_regionkey"))).alias("main"), F.round(share, 6).alias("share"), (share > 0.8).alias("specific"))


@query("M33_signal_to_noise", "SELECT p_brand, round((avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') - avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R')) / (stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') + stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag <> 'R')), 6) AS s2n, round(log2((avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') + 1) / (avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R') + 1)), 6) AS log2fc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def m33(spark, sf):
    case, v = F.col("l_returnflag") == "R", F.col("l_extendedprice")
    one, two = F.when(case, v), F.when(~case, v)
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.round((F.avg(one) - F.avg(two)) / (F.stddev_samp(one) + F.stddev_samp(two)), 6).alias("s2n"), F.round(F.log2((F.avg(one) + 1) / (F.avg(two) + 1)), 6).alias("log2fc"))


@query("M36_target_ranking", "WITH s AS (SELECT l_partkey k, count(*) n, avg(l_discount) d FROM lineitem GROUP BY 1) SELECT p_partkey, round(0.4 * least(n / 40.0, 1) + 0.4 * d * 10 + 0.2 * (p_type = 'ECONOMY')::INT, 6) AS score FROM part JOIN s ON p_partkey = k ORDER BY score DESC, p_partkey LIMIT 50")
def m36(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"))
    score = 0.4 * F.least(F.col("n") / 40.0, F.lit(1.0)) + 0.4 * F.col("d") * 10 + 0.2 * (F.col("p_type") == "ECONOMY").cast("int")
    return table(spark, sf, "part").join(s, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@query("M37_identifier_normalisation", "WITH a AS (SELECT s_name alias, s_suppkey id, 1 p FROM supplier UNION ALL SELECT 'S' || s_suppkey, s_suppkey, 2 FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_suppkey, 3 FROM supplier), m AS (SELECT alias, arg_min(id, p) AS id FROM a GROUP BY 1), q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'S' || l_suppkey WHEN 1 THEN CAST(l_suppkey AS VARCHAR) ELSE 'unknown' END AS raw FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, id FROM q LEFT JOIN m ON raw = alias")
def m37(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    names = s.select(F.explode(F.array(F.struct(F.col("s_name").alias("alias"), F.lit(1).alias("p")), F.struct(F.concat(F.lit("S"), key).alias("alias"), F.lit(2).alias("p")), F.struct(key.alias("alias"), F.lit(3).alias("p")))).alias("a"), "s_suppkey").groupBy("a.alias").agg(F.min_by("s_suppkey", "a.p").alias("id"))
    m, k = F.col("l_linenumber") % 3, F.col("l_suppkey").cast("string")
    q = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(m == 0, F.concat(F.lit("S"), k)).when(m == 1, k).otherwise("unknown").alias("alias"))
    return q.join(names, "alias", "left").select("l_orderkey", "l_linenumber", "l_partkey", "id")


@query(
    "M40_interaction",
    """WITH d AS (SELECT l_returnflag k, l_extendedprice / 1000 AS y, l_quantity AS g, l_discount * 100 AS e, l_quantity * l_discount * 100 AS ge FROM lineitem), a AS (SELECT k, regr_slope(e, g) AS se, regr_slope(ge, g) AS sw, regr_slope(y, g) AS sy FROM d GROUP BY 1),
r AS (SELECT k, e - se * g AS e1, ge - sw * g AS w1, y - sy * g AS y1 FROM d JOIN a USING (k)), b AS (SELECT k, regr_slope(w1, e1) AS tw, regr_slope(y1, e1) AS ty FROM r GROUP BY 1), z AS (SELECT k, w1 - tw * e1 AS w2, y1 - ty * e1 AS y2 FROM r JOIN b USING (k)) SELECT k, round(regr_slope(y2, w2), 5) AS interaction FROM z GROUP BY 1""",
)
def m40(spark, sf):
    """The product term of gene and environment beside both; SQL takes it from residuals."""
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("g"), (F.col("l_discount") * 100).alias("e")).withColumn("ge", F.col("g") * F.col("e"))
    return M.ols(d, ["k"], "y", ["g", "e", "ge"], ["gene", "environment", "interaction"]).select("k", F.round("interaction", 5).alias("interaction"))


@query("M42_sensitivity_bounds", "SELECT l_suppkey, round(avg(l_discount) - 0.01, 6) AS low, round(avg(l_discount) + 0.01, 6) AS high, avg(l_discount) - 0.01 > 0 AS robust FROM lineitem GROUP BY 1")
def m42(spark, sf):
    e = F.avg("l_discount")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(e - 0.01, 6).alias("low"), F.round(e + 0.01, 6).alias("high"), (e - 0.01 > 0).alias("robust"))


@query("M47_M58_signals")
def m47(spark, sf):
    return signals.recordings(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 100.0)


@query("M49_eqtl_slopes", "SELECT p_brand AS gene, l_returnflag AS cell, round(regr_slope(l_extendedprice, l_linenumber), 3) AS beta, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def m49(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("gene"), F.col("l_returnflag").alias("cell")).agg(F.round(F.regr_slope("l_extendedprice", "l_linenumber"), 3).alias("beta"), F.count(F.lit(1)).alias("n"))


@query("M51_fdr_after_top", "WITH p AS (SELECT l_suppkey k, exp(-abs(avg(l_discount) - 0.05) * 1000) AS p FROM lineitem GROUP BY 1), t AS (SELECT * FROM p ORDER BY p, k LIMIT 20), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, k) AS raw FROM t) SELECT k, round(least(min(raw) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS q FROM r")
def m51(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.exp(-F.abs(F.avg("l_discount") - 0.05) * 1000).alias("p")).orderBy("p", "k").limit(20).withColumn("one", F.lit(1))
    return S.with_fdr(p, ["one"], "p", "k").select("k", F.round("q", 8).alias("q"))


@query("M52_gradient_correlation", "WITH v AS (SELECT l_suppkey k, avg(l_quantity) a, avg(l_extendedprice) b FROM lineitem GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM v) SELECT round(corr(ra, rb), 6) AS spearman FROM r")
def m52(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_extendedprice").alias("b")).withColumn("one", F.lit(1))
    return v.withColumns({"ra": S.average_rank(["one"], "a"), "rb": S.average_rank(["one"], "b")}).agg(F.round(F.corr("ra", "rb"), 6).alias("spearman"))


@query("M55_secure_sum", "SELECT l_returnflag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def m55(spark, sf):
    """Each site adds a mask and its neighbour subtracts it, so that only the sum is revealed."""
    site = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    mask = lambda k: S.seeded(F.concat_ws("-", "l_returnflag", k.cast("string")), 3) * 1000
    ring = Window.partitionBy("l_returnflag").orderBy("l_suppkey")
    whole = Window.partitionBy("l_returnflag")
    last = F.max("l_suppkey").over(whole)
    sent = site.withColumn("masked", F.col("v") + mask(F.col("l_suppkey")) - mask(F.coalesce(F.lag("l_suppkey").over(ring), last)))
    return sent.groupBy("l_returnflag").agg(F.round(F.sum("masked"), 2).alias("total"))


@query("M60_trimester", "WITH f AS (SELECT user_id, value, date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)) d FROM events) SELECT user_id, CASE WHEN d < 10 THEN 'first' WHEN d < 20 THEN 'second' ELSE 'third' END AS trimester, count(*) AS n, least(sum((value > 40)::INT), 10)::BIGINT AS risk FROM f GROUP BY ALL")
def m60(spark, sf):
    e = table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("f"))
    d = F.datediff("ts", "f")
    return e.join(first, "user_id").groupBy("user_id", F.when(d < 10, "first").when(d < 20, "second").otherwise("third").alias("trimester")).agg(F.count(F.lit(1)).alias("n"), F.least(F.count_if(F.col("value") > 40), F.lit(10)).alias("risk"))


@query("M65_quality_rating", "WITH c AS (SELECT l_suppkey k, avg((l_discount > 0.01)::INT) * 50 + avg((l_tax > 0.01)::INT) * 50 AS s FROM lineitem GROUP BY 1) SELECT k, round(s, 4) AS score, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 60 THEN 'fair' ELSE 'poor' END AS rating FROM c")
def m65(spark, sf):
    s = F.avg((F.col("l_discount") > 0.01).cast("int")) * 50 + F.avg((F.col("l_tax") > 0.01).cast("int")) * 50
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(s.alias("s"))
    return c.select("k", F.round("s", 4).alias("score"), F.when(F.col("s") >= 90, "excellent").when(F.col("s") >= 75, "good").when(F.col("s") >= 60, "fair").otherwise("poor").alias("rating"))


@query("M67_panel", "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click') * 362 / nullif(avg(value) FILTER (WHERE event_type = 'error'), 0), 4) AS ratio, round(avg(value) FILTER (WHERE event_type = 'click') * avg(value) FILTER (WHERE event_type = 'error') / 405, 6) AS homa, round(avg((value > 40)::INT) * 100, 6) AS elevated FROM events GROUP BY 1")
def m67(spark, sf):
    of = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(of("click") * 362 / F.nullif(of("error"), F.lit(0.0)), 4).alias("ratio"), F.round(of("click") * of("error") / 405, 6).alias("homa"), F.round(F.avg((F.col("value") > 40).cast("int")) * 100, 6).alias("elevated"))


@query("M67_onset", "WITH f AS (SELECT user_id, event_id, value, avg(value) OVER w + 2 * stddev_samp(value) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id)) SELECT user_id, min(event_id) AS onset FROM f WHERE value > t GROUP BY 1")
def m67b(spark, sf):
    e = table(spark, sf, "events")
    t = e.groupBy("user_id").agg((F.avg("value") + 2 * F.stddev_samp("value")).alias("t"))
    return e.join(t, "user_id").filter("value > t").groupBy("user_id").agg(F.min("event_id").alias("onset"))


@query("M73_dictionary_categories", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'hardware' WHEN regexp_matches(p_name, 'widget|gear') THEN 'machine' ELSE 'other' END AS category FROM part")
def m73(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.when(n.rlike("ring|bolt"), "hardware").when(n.rlike("widget|gear"), "machine").otherwise("other").alias("category"))


@query("M74_haversine_km", "SELECT s_suppkey, round(2 * 6371 * asin(sqrt(least(pow(sin(radians(s_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(s_nationkey)) * pow(sin(radians(s_suppkey % 90) / 2), 2), 1.0))), 4) AS km FROM supplier")
def m74(spark, sf):
    d = J.haversine(F.lit(10.0), F.lit(0.0), F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 90).cast("double"))
    return table(spark, sf, "supplier").select("s_suppkey", F.round(d, 4).alias("km"))


@query("M75_manifest_diff", "WITH a AS (SELECT o_orderpriority step, count(*) n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority step, count(*) n FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' GROUP BY 1) SELECT step, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (step)")
def m75(spark, sf):
    o = table(spark, sf, "orders")
    n = lambda df, name: df.groupBy(F.col("o_orderpriority").alias("step")).agg(F.count(F.lit(1)).alias(name))
    both = n(o.filter("o_orderstatus = 'F'"), "before").join(n(o.filter("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'"), "after"), "step", "outer").fillna(0)
    return both.withColumn("change", F.col("after") - F.col("before"))


@query("W19_turn_taking", "SELECT role, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, count(*) FILTER (WHERE pr = role) AS same_speaker FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS pr FROM conversations) GROUP BY 1")
def w19(spark, sf):
    c = table(spark, sf, "conversations").withColumn("pr", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.count_if(F.col("pr") == F.col("role")).alias("same_speaker"))
