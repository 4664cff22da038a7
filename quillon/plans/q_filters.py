"""Filters and quality control over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.operators import filters as P
from quillon.registry import query
from quillon.sources.tables import table

#: A cohort with missing values, from the orders: a row an order, four measures.
_COHORT_SQL = """cohort AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS a,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 2 END AS b, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS c,
 CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS d FROM orders)"""


def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    unless = lambda m, c: F.when(k % m == 0, None).otherwise(c.cast("double"))
    return o.select(k.alias("id"), unless(7, F.col("o_totalprice")).alias("a"), unless(3, F.col("o_totalprice") / 2).alias("b"), unless(11, F.col("o_custkey")).alias("c"), unless(2, k).alias("d"))


_RATE = "((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT + (d IS NULL)::INT) / 4.0"


@query("P1_row_missingness", f"WITH {_COHORT_SQL} SELECT id FROM cohort WHERE {_RATE} < 0.3")
def p1(spark, sf):
    return P.rows_with_few_missing(_cohort(spark, sf), list("abcd"), 0.3).select("id")


@query("P2_column_missingness", f"WITH {_COHORT_SQL} SELECT id, a, b, c FROM cohort WHERE {_RATE} < 0.6")
def p2(spark, sf):
    return P.missingness_filter(_cohort(spark, sf), ["id"], list("abcd"), 0.6, 0.4)


@query(
    "P3_zscore_outliers",
    """WITH m AS (SELECT avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) mp, stddev_samp(l_extendedprice) sp, avg(l_tax) mt, stddev_samp(l_tax) st FROM lineitem)
SELECT l_orderkey, l_linenumber FROM lineitem, m WHERE ((abs((l_quantity - mq) / sq) > 1.5)::INT + (abs((l_extendedprice - mp) / sp) > 1.5)::INT + (abs((l_tax - mt) / st) > 1.5)::INT) / 3.0 <= 0.2""",
)
def p3(spark, sf):
    return P.drop_outlier_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), ["l_quantity", "l_extendedprice", "l_tax"], 1.5, 0.2).select("l_orderkey", "l_linenumber")


@query(
    "P4_depth_prevalence",
    """WITH deep AS (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 1000), k AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM deep)),
seen AS (SELECT l_partkey FROM k GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_quantity > 0 THEN l_suppkey END) >= 0.05 * (SELECT count(*) FROM deep))
SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS depth FROM k WHERE l_partkey IN (SELECT l_partkey FROM seen) GROUP BY 1""",
)
def p4(spark, sf):
    kept = P.depth_and_prevalence(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity"), "l_suppkey", "l_partkey", "l_quantity", 1000, 0.05)
    return kept.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("depth"))


@query(
    "P5_qc_metrics",
    f"""WITH {_COHORT_SQL}, m AS (SELECT avg(a) ma, stddev_samp(a) sa, avg(b) mb, stddev_samp(b) sb FROM cohort)
SELECT count(*) AS n_samples, round(avg(((a IS NULL)::INT + (b IS NULL)::INT) / 2.0), 6) AS missing_rate, count(id) - count(DISTINCT id) AS n_duplicates,
 count(*) FILTER (WHERE coalesce(abs((a - ma) / sa) > 1.6, false) OR coalesce(abs((b - mb) / sb) > 1.6, false)) AS n_outliers FROM cohort, m""",
)
def p5(spark, sf):
    return P.qc_metrics(_cohort(spark, sf), "id", ["a", "b"], 1.6).withColumn("missing_rate", F.round("missing_rate", 6))


@query(
    "P6_range_checks",
    """SELECT 'balance' AS rule, count(*) FILTER (WHERE NOT coalesce(c_acctbal BETWEEN -500 AND 9000, false)) AS violations, count(*) FILTER (WHERE NOT coalesce(c_acctbal BETWEEN -500 AND 9000, false)) = 0 AS valid FROM customer
UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment IS NULL), count(*) FILTER (WHERE c_mktsegment IS NULL) = 0 FROM customer
UNION ALL SELECT 'rich_building', count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0), count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0) = 0 FROM customer""",
)
def p6(spark, sf):
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    return P.contract(table(spark, sf, "customer"), {"balance": bal.between(-500, 9000), "segment": seg.isNotNull(), "rich_building": ~((seg == "BUILDING") & (bal < 0))})


@query("P7_significant_top", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount < 0.02 AND abs(l_quantity - 25) > 5 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def p7(spark, sf):
    hits = table(spark, sf, "lineitem", (F.col("l_discount") < 0.02) & (F.abs(F.col("l_quantity") - 25) > 5))
    return hits.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("P8_attribute_search", "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#11'")
def p8(spark, sf):
    return P.search(table(spark, sf, "part"), p_type="ECONOMY", p_brand="Brand#11", p_size=None).select("p_partkey", "p_name")


@query("P9_catalog_text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR list_contains(string_split(lower(p_name), ' '), 'ring')")
def p9(spark, sf):
    term = lambda c: F.lower(c).contains("red")
    return table(spark, sf, "part").filter(term("p_name") | term("p_brand") | F.exists(F.split("p_name", " "), lambda x: F.lower(x) == "ring")).select("p_partkey")


@query(
    "P10_recent_alerts",
    """WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS level FROM events)
SELECT event_id, level FROM e WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND level >= 1""",
)
def p10(spark, sf):
    e = table(spark, sf, "events")
    level = F.coalesce(F.create_map(*(F.lit(x) for kv in {"error": 3, "purchase": 2, "click": 1}.items() for x in kv))[F.col("event_type")], F.lit(0))
    newest = e.agg(F.max("ts").alias("_now"))
    return e.crossJoin(F.broadcast(newest)).withColumn("level", level).filter((F.col("ts") >= F.col("_now") - F.expr("INTERVAL 24 HOURS")) & (F.col("level") >= 1)).select("event_id", "level")


@query("P11_row_flags", f"WITH {_COHORT_SQL} SELECT id, CASE WHEN a >= 250000 THEN 1 ELSE 0 END AS flag, greatest(a, b) AS hi, round(coalesce(a, 0) + coalesce(b, 0), 4) AS total, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 4) AS mean FROM cohort")
def p11(spark, sf):
    a, b = F.col("a"), F.col("b")
    total = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return _cohort(spark, sf).select("id", F.when(a >= 250000, 1).otherwise(0).alias("flag"), F.greatest(a, b).alias("hi"), F.round(total, 4).alias("total"), F.round(total / F.nullif(n, F.lit(0)), 4).alias("mean"))


@query("P12_rule_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'very_high' WHEN o_totalprice >= 250000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'moderate' ELSE 'low' END AS burden FROM orders")
def p12(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.when(p >= 400000, "very_high").when(p >= 250000, "high").when(p >= 100000, "moderate").otherwise("low").alias("burden"))


@query("P13_contract", "SELECT 'id' AS rule, 0::BIGINT AS violations, true AS valid UNION ALL SELECT 'flag', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')), count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) = 0 FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (WHERE l_quantity > 45), count(*) FILTER (WHERE l_quantity > 45) = 0 FROM lineitem")
def p13(spark, sf):
    return P.contract(table(spark, sf, "lineitem"), {"id": F.col("l_orderkey").isNotNull(), "flag": F.col("l_returnflag").isin("A", "R"), "quantity": F.col("l_quantity") <= 45})


@query("P14_noise_filter", "SELECT vec_id FROM embeddings WHERE label >= 2 AND embedding[1] >= 0")
def p14(spark, sf):
    return table(spark, sf, "embeddings").filter((F.col("label") >= 2) & (F.col("embedding")[0] >= 0)).select("vec_id")


@query("P15_drop_constant", f"WITH {_COHORT_SQL} SELECT id, coalesce(b, 0) AS b, coalesce(d, 0) AS d FROM cohort")
def p15(spark, sf):
    return P.drop_constant_columns(_cohort(spark, sf).select("id", "b", "d").withColumn("k", F.lit(1.0)), ["b", "d", "k"])


@query(
    "P16_prevalence",
    """WITH r AS (SELECT user_id FROM events WHERE value > 5 GROUP BY 1 HAVING count(DISTINCT event_type) >= 4), c AS (SELECT event_type FROM events WHERE value > 5 GROUP BY 1 HAVING count(DISTINCT user_id) >= 10)
SELECT e.user_id, e.event_type, count(*) AS n FROM events e WHERE user_id IN (SELECT user_id FROM r) AND event_type IN (SELECT event_type FROM c) GROUP BY ALL""",
)
def p16(spark, sf):
    e = table(spark, sf, "events").withColumn("over", F.col("value") - 5)
    return P.prevalence(e, "user_id", "event_type", "over", 4, 10).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("F1_type_inference", "SELECT 'l_linenumber' AS column_name, count(DISTINCT l_linenumber) AS n_distinct, 'ordinal' AS kind FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), 'binary' FROM lineitem UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey), 'count' FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity), 'continuous' FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'categorical' FROM lineitem")
def f1(spark, sf):
    return infer_types(table(spark, sf, "lineitem").select("l_linenumber", "l_linestatus", "l_orderkey", "l_quantity", "l_returnflag"))


def infer_types(df: DataFrame) -> DataFrame:
    """binary: two values; integers: ordinal up to ten values, else count; other numbers continuous; text categorical up to twenty values."""
    kinds = {c: t for c, t in df.dtypes}
    one = df.agg(*(F.count_distinct(c).alias(c) for c in df.columns)).unpivot([], df.columns, "column_name", "n_distinct")
    whole = [c for c, t in kinds.items() if t in ("tinyint", "smallint", "int", "bigint")]
    real = [c for c, t in kinds.items() if t in ("float", "double") or t.startswith("decimal")]
    n, c = F.col("n_distinct"), F.col("column_name")
    kind = F.when(n == 2, "binary").when(c.isin(whole), F.when(n <= 10, "ordinal").otherwise("count")).when(c.isin(real), "continuous").when(n <= 20, "categorical").otherwise("text")
    return one.withColumn("kind", kind)
