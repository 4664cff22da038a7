"""Feature selection, projection, resampling and explanation over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.operators import stats as M
from quillon.operators import density
from quillon.registry import query
from quillon.sources.tables import table

_CENTROIDS = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL), d AS (SELECT x.vec_id, c.label, sqrt(sum((x.v - c.m) * (x.v - c.m))) AS d FROM x JOIN c USING (i) GROUP BY ALL)"


def _distances(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    c = x.groupBy(F.col("label").alias("c"), "i").agg(F.avg("v").alias("m"))
    return x.join(c, "i").groupBy("vec_id", "c").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("d"))


@query("M29_projector", f"WITH {_CENTROIDS}, w AS (SELECT vec_id, label, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p, d FROM d) SELECT vec_id, arg_min(label, d) AS projected, round(max(p), 6) AS confidence FROM w GROUP BY 1")
def projector(spark, sf):
    """Nearest centroid, with a softmax over negative distances for confidence."""
    w = _distances(spark, sf).withColumn("p", F.exp(-F.col("d")) / F.sum(F.exp(-F.col("d"))).over(Window.partitionBy("vec_id")))
    return w.groupBy("vec_id").agg(F.min_by("c", F.struct("d", "c")).alias("projected"), F.round(F.max("p"), 6).alias("confidence"))


@query(
    "M16_vote_confidence",
    "WITH v AS (SELECT vec_id, unnest([label, (embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT, (embedding[3] > 0)::INT * 2 + (embedding[4] > 0)::INT]) AS l FROM embeddings), n AS (SELECT vec_id, l, count(*) n FROM v GROUP BY ALL) SELECT vec_id, arg_max(l, (n, -l)) AS label, round(max(n) / sum(n), 6) AS confidence FROM n GROUP BY 1",
)
def votes(spark, sf):
    """The most frequent label of three given partitions: labels, and signs of two pairs of components."""
    up = lambda k: (F.get("embedding", F.lit(k)) > 0).cast("int")
    runs = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array("label", up(0) * 2 + up(1), up(2) * 2 + up(3))).alias("l"))
    return density.vote(runs, "vec_id", "l").select("vec_id", "label", F.round("confidence", 6).alias("confidence"))


@query("M22_stability_selection")
def stability(spark, sf):
    """Share of 50 seeded half-samples in which a component's group difference is among the ten largest; one grouped plan."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") < 5).alias("g"), F.col("embedding").cast("array<double>").alias("x"))
    drawn = e.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(50)))).filter(S.seeded(F.concat_ws("-", F.col("vec_id").cast("string"), F.col("draw").cast("string")), 5) < 0.5)
    long = drawn.select("draw", "g", F.posexplode("x").alias("i", "v"))
    d = long.groupBy("draw", "i").agg(F.abs(F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("d"))
    top = d.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("d"), "i")))
    return top.groupBy("i").agg(F.avg((F.col("r") <= 10).cast("double")).alias("selected"))


@query("M54_bootstrap")
def bootstrap(spark, sf):
    """Percentile interval of the mean by Poisson weights from hashes: 200 replicates without moving rows twice."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(200))))
    u = S.seeded(F.concat_ws("-", F.col("c_custkey").cast("string"), F.col("draw").cast("string")), 11)
    cumulative, p, total = [], 0.36787944117144233, 0.0
    for k in range(6):
        total += p
        cumulative.append(total)
        p /= k + 1
    weight = sum(((u >= x).cast("int") for x in cumulative), F.lit(0))
    means = c.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("c_acctbal")) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


@query("M46_partial_correlation", "WITH g AS (SELECT l_returnflag k, corr(l_extendedprice, l_quantity) xy, corr(l_extendedprice, l_partkey) xz, corr(l_quantity, l_partkey) yz FROM lineitem GROUP BY 1) SELECT k, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM g")
def partial(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.corr("l_extendedprice", "l_quantity").alias("xy"), F.corr("l_extendedprice", "l_partkey").alias("xz"), F.corr("l_quantity", "l_partkey").alias("yz"))
    return g.select("k", F.round((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)), 6).alias("partial"))


@query("M57_forest_importance")
def forest(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=3).fit(e)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())], "feature int, importance double")


@query("M63_gwas_summary", "SELECT n_regionkey, count(*) AS n, count(*) FILTER (WHERE l_discount < 0.01) AS significant, round(min(l_discount), 4) AS lead, arg_min(l_orderkey, (l_discount, l_orderkey)) AS lead_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def gwas(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") < 0.01).alias("significant"), F.round(F.min("l_discount"), 4).alias("lead"), F.min_by("l_orderkey", F.struct("l_discount", "l_orderkey")).alias("lead_id"))


@query("M77_cluster_table", f"WITH {_CENTROIDS}, o AS (SELECT e.vec_id, e.label, d.d FROM embeddings e JOIN d ON d.vec_id = e.vec_id AND d.label = e.label) SELECT label, count(*) AS n, round(avg(d), 5) AS compactness, round(max(d), 5) AS radius FROM o GROUP BY 1")
def profile(spark, sf):
    o = table(spark, sf, "embeddings").select("vec_id", "label").join(_distances(spark, sf), "vec_id").filter("label = c")
    return o.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 5).alias("compactness"), F.round(F.max("d"), 5).alias("radius"))


@query("M41_two_stage", "WITH g AS (SELECT l_returnflag k, regr_slope(l_quantity, l_linenumber) b, regr_intercept(l_quantity, l_linenumber) a FROM lineitem GROUP BY 1), h AS (SELECT k, a + b * l_linenumber AS xh, l_extendedprice AS y FROM lineitem JOIN g ON l_returnflag = k) SELECT k, round(regr_slope(y, xh), 1) AS effect FROM h GROUP BY 1")
def two_stage(spark, sf):
    """Two-stage least squares with one instrument."""
    l = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "k")
    first = M.ols(l, ["k"], "l_quantity", ["l_linenumber"], ["b"]).select("k", "intercept", "b")
    fitted = l.join(first, "k").withColumn("xh", F.col("intercept") + F.col("b") * F.col("l_linenumber"))
    return fitted.groupBy("k").agg(F.round(F.regr_slope("l_extendedprice", "xh"), 1).alias("effect"))
