"""Series rates, mixtures, critical periods, spatial specificity and sample views over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import mixtures as X
from quillon.operators import windows as W
from quillon.registry import query
from quillon.sources import synthetic
from quillon.sources.tables import table


@query(
    "W23_coarticulation",
    """WITH d AS (SELECT user_id, value, row_number() OVER w - 1 AS frame, abs(value - lag(value) OVER w) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(avg(rate), 6) AS rate_per_frame, round(regr_slope(value, frame), 6) AS slope FROM d GROUP BY 1 HAVING count(*) > 1""",
)
def w23(spark, sf):
    r = W.transition_rate(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    return r.select("user_id", F.round("rate_per_frame", 6).alias("rate_per_frame"), F.round("slope", 6).alias("slope"))


@query(
    "W25_moving_integration",
    """WITH d AS (SELECT user_id, row_number() OVER w AS i, power(value - lag(value) OVER w, 2) AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT user_id, i, round(sum(e) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS m FROM d WHERE e IS NOT NULL), t AS (SELECT *, lag(m) OVER w AS before, lead(m) OVER w AS after, round(avg(m) OVER (PARTITION BY user_id), 6) AS level FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i)),
p AS (SELECT user_id, i, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM t WHERE m > before AND m >= after AND m > level) SELECT user_id, count(*) AS n_peaks, round(avg(gap), 6) AS mean_gap FROM p GROUP BY 1""",
)
def w25(spark, sf):
    p = W.energy_peaks(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_peaks"), F.round(F.avg("gap"), 6).alias("mean_gap"))


# Subsets of 6 in 10 rows, as arithmetic that SQL has too.
_DRAWS = 10
_IN = "(l_orderkey * 7 + l_linenumber) * {k} % 101 % 10 < 6"
_FEATURES = ("l_quantity", "l_discount", "l_tax")


def _wqs_sql() -> str:
    ranked = " UNION ALL ".join(f"SELECT '{c}' AS f, {c} AS v FROM lineitem" for c in _FEATURES)
    weights = ", ".join(f"abs(corr(q, y) FILTER (WHERE {_IN.format(k=2 * b + 3)})) AS c{b}" for b in range(_DRAWS))
    share = " + ".join(f"c{b} / sum(c{b}) OVER ()" for b in range(_DRAWS))
    return f"""WITH u AS ({ranked}), n AS (SELECT f, v, count(*) AS k FROM u GROUP BY ALL), r AS (SELECT f, v, (sum(k) OVER (PARTITION BY f ORDER BY v) - (k - 1) / 2.0) / (sum(k) OVER (PARTITION BY f) + 1) AS q FROM n),
l AS (SELECT l_orderkey, l_linenumber, f, q, l_extendedprice AS y FROM (SELECT *, unnest(['l_quantity', 'l_discount', 'l_tax']) AS f, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) JOIN r USING (f, v)),
c AS (SELECT f, {weights} FROM l GROUP BY 1), w AS (SELECT f, ({share}) / {_DRAWS} AS weight FROM c), g AS (SELECT r.f, v, q * weight AS g FROM r JOIN w USING (f)),
i AS (SELECT l_extendedprice AS y, {' + '.join(f"{c}_.g" for c in _FEATURES)} AS x FROM lineitem {' '.join(f"JOIN g {c}_ ON {c}_.f = '{c}' AND {c}_.v = {c}" for c in _FEATURES)}), e AS (SELECT regr_slope(y, x) AS effect, corr(y, x) AS r FROM i)
SELECT f AS feature, round(weight, 6) AS weight, round(effect, 3) AS effect, round(r, 6) AS r FROM w CROSS JOIN e"""


@query("M44_mixture", _wqs_sql())
def m44(spark, sf):
    l = table(spark, sf, "lineitem")
    subsets = [F.expr(_IN.format(k=2 * b + 3)) for b in range(_DRAWS)]
    r = X.quantile_mixture(l, list(_FEATURES), "l_extendedprice", subsets)
    return r.select("feature", F.round("weight", 6).alias("weight"), F.round("effect", 3).alias("effect"), F.round("r", 6).alias("r"))


@query(
    "M44_critical_periods",
    """WITH u AS (SELECT user_id, CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END AS period, avg(value) AS x FROM events GROUP BY ALL), o AS (SELECT user_id, stddev_samp(value) AS y FROM events GROUP BY 1),
s AS (SELECT period, count(*) AS n, regr_slope(y, x) AS effect, corr(y, x) AS r FROM u JOIN o USING (user_id) WHERE y IS NOT NULL GROUP BY 1) SELECT period, n, round(effect, 6) AS effect, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t, abs(effect) = max(abs(effect)) OVER () AS strongest FROM s""",
)
def m44b(spark, sf):
    e, h = table(spark, sf, "events"), F.hour("ts")
    period = F.when(h < 8, "night").when(h < 16, "day").otherwise("evening")
    outcome = e.groupBy("user_id").agg(F.stddev_samp("value").alias("y")).filter("y is not null")
    long = e.groupBy("user_id", period.alias("period")).agg(F.avg("value").alias("x")).join(outcome, "user_id")
    return X.critical_periods(long, "period", "x", "y").select("period", "n", F.round("effect", 6).alias("effect"), F.round("t", 5).alias("t"), "strongest")


@query(
    "M53_spatial_specificity",
    """WITH m AS (SELECT l_partkey AS gene, avg(abs(l_quantity * l_discount)) FILTER (WHERE l_returnflag = 'R') AS inside, avg(abs(l_quantity * l_discount)) FILTER (WHERE l_returnflag <> 'R') AS outside FROM lineitem GROUP BY 1)
SELECT gene, round(CASE WHEN inside + outside > 0 THEN inside / (inside + outside) ELSE 0 END, 6) AS specificity FROM m""",
)
def m53(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("effect", F.col("l_quantity") * F.col("l_discount")).withColumnRenamed("l_partkey", "gene")
    return X.specificity(l, ["gene"], "effect", F.col("l_returnflag") == "R").select("gene", F.round("specificity", 6).alias("specificity"))


@query("M78_synthetic_cohort")
def m78(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return synthetic.cohort(ids, "id", features=4)


@query(
    "Q1_sample_views",
    """SELECT c_mktsegment AS cohort, count(DISTINCT c_custkey) AS samples, count(o_orderkey) AS datasets, count(*) FILTER (WHERE o_orderstatus = 'F') AS consented FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def q1(spark, sf):
    """Views stand for the index's tables; the statement reads them by name."""
    table(spark, sf, "customer").selectExpr("c_custkey AS master_id", "c_mktsegment AS cohort").createOrReplaceTempView("samples")
    table(spark, sf, "orders").selectExpr("o_custkey AS master_id", "o_orderkey AS dataset_id", "o_orderstatus AS consent").createOrReplaceTempView("sample_datasets")
    return spark.sql("SELECT cohort, count(DISTINCT master_id) AS samples, count(dataset_id) AS datasets, count_if(consent = 'F') AS consented FROM samples LEFT JOIN sample_datasets USING (master_id) GROUP BY cohort")
