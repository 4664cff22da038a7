"""Set operations, reshaping and the embedded SQL over the standard tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.registry import query
from quillon.sources import sinks
from quillon.sources.tables import table


@query("U1_union_both_directions", "SELECT l_suppkey AS a, l_partkey AS b FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem")
def u1(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).unionAll(l.select("l_partkey", "l_suppkey")).distinct()


@query("U2_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u2(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("U3_intersect", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def u3(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf, "orders").select("o_custkey"))


@query("U4_shared_hits", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.09 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09")
def u4(spark, sf):
    hit = lambda f: table(spark, sf, "lineitem", (F.col("l_returnflag") == f) & (F.col("l_discount") >= 0.09)).select(F.col("l_partkey").alias("k"))
    return hit("A").intersect(hit("R"))


@query("U5_merge_sets", "SELECT p_brand AS set_id, count(DISTINCT p_partkey) AS size FROM (SELECT p_brand, p_partkey FROM part WHERE p_size > 20 UNION ALL SELECT p_brand, p_partkey FROM part WHERE p_type = 'ECONOMY') GROUP BY 1")
def u5(spark, sf):
    p = table(spark, sf, "part")
    both = p.filter("p_size > 20").unionByName(p.filter("p_type = 'ECONOMY'"))
    return both.groupBy(F.col("p_brand").alias("set_id")).agg(F.count_distinct("p_partkey").alias("size"))


@query("U6_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def u6(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf, "orders", "o_totalprice > 200000").select("o_custkey"))


@query(
    "U7_jaccard_sets",
    "WITH s AS (SELECT event_type k, count(DISTINCT user_id) n FROM events WHERE value > 60 GROUP BY 1), d AS (SELECT DISTINCT event_type k, user_id u FROM events WHERE value > 60), i AS (SELECT a.k x, b.k y, count(*) n FROM d a JOIN d b ON a.u = b.u AND a.k < b.k GROUP BY ALL) SELECT x, y, round(i.n / (a.n + b.n - i.n), 6) AS jaccard FROM i JOIN s a ON a.k = x JOIN s b ON b.k = y",
)
def u7(spark, sf):
    d = table(spark, sf, "events", "value > 60").select(F.col("event_type").alias("k"), F.col("user_id").alias("u")).distinct()
    n = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    both = d.withColumnRenamed("k", "x").join(d.withColumnRenamed("k", "y"), "u").filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("i"))
    sized = both.join(n.toDF("x", "nx"), "x").join(n.toDF("y", "ny"), "y")
    return sized.select("x", "y", F.round(F.col("i") / (F.col("nx") + F.col("ny") - F.col("i")), 6).alias("jaccard"))


@query(
    "U8_enrichment_cells",
    """WITH g AS (SELECT p_partkey k, p_brand b, p_size > 40 AS hit FROM part), t AS (SELECT count(*) n, count(*) FILTER (WHERE hit) h FROM g) SELECT b AS set_id, count(*) FILTER (WHERE hit) AS a, count(*) FILTER (WHERE NOT hit) AS b, h - count(*) FILTER (WHERE hit) AS c, n - h - count(*) FILTER (WHERE NOT hit) AS d FROM g, t GROUP BY b, h, n""",
)
def u8(spark, sf):
    g = table(spark, sf, "part").select(F.col("p_brand").alias("set_id"), (F.col("p_size") > 40).alias("hit"))
    t = g.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    cells = g.groupBy("set_id").agg(F.count_if("hit").alias("a"), F.count_if(~F.col("hit")).alias("b")).crossJoin(F.broadcast(t))
    return cells.select("set_id", "a", "b", (F.col("h") - F.col("a")).alias("c"), (F.col("n") - F.col("h") - F.col("b")).alias("d"))


@query("R1_pivot", "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS error, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view FROM events GROUP BY 1")
def r1(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.round(F.avg("value"), 6))


@query("R2_twin_difference", "WITH t AS (SELECT o_custkey AS pair, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS twin FROM orders) SELECT pair, round(max(v) FILTER (WHERE twin = 1) - max(v) FILTER (WHERE twin = 2), 4) AS difference FROM t GROUP BY 1 HAVING count(*) >= 2")
def r2(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("pair"), F.col("o_totalprice").alias("v"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("twin"))
    of = lambda k: F.max(F.when(F.col("twin") == k, F.col("v")))
    return t.groupBy("pair").agg(F.round(of(1) - of(2), 4).alias("difference"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")


@query("R3_date_hour", "SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def r3(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("R4_unpivot", "SELECT l_returnflag, feature, round(avg(value), 6) AS mean FROM (SELECT l_returnflag, unnest(['l_discount', 'l_quantity', 'l_tax']) AS feature, unnest([l_discount, l_quantity, l_tax]) AS value FROM lineitem) GROUP BY ALL")
def r4(spark, sf):
    from quillon.functions.semantics import long_form

    return long_form(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_discount", "l_quantity", "l_tax"]).groupBy("l_returnflag", "feature").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("R5_dummies", "SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'N')::INT AS l_returnflag_N, (l_returnflag = 'R')::INT AS l_returnflag_R FROM lineitem")
def r5(spark, sf):
    return dummies(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "l_returnflag").drop("l_returnflag")


MOST_LEVELS = 1000


def dummies(df: DataFrame, column: str, drop_first: bool = True) -> DataFrame:
    """One 0/1 column a level in sorted order; by default without the first level. The levels are columns, so few."""
    found = df.select(column).distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"over {MOST_LEVELS} levels of {column}")
    levels = sorted(r[0] for r in found if r[0] is not None)
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in levels[1 if drop_first else 0 :]})


@query("R6_explode_split", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def r6(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SNK5_upsert_replace", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def upsert(spark, sf):
    return sinks.upsert(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SNK5_upsert_ignore", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def ignore(spark, sf):
    return sinks.upsert(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], replace=False).select("o_custkey", "o_orderkey")


def matching(conditions: dict) -> Column:
    """All given conditions: column to value, or to (comparison, value). None leaves a condition out."""
    compare = {"=": lambda c, v: c == v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v}
    out = F.lit(True)
    for name, want in conditions.items():
        if want is not None:
            how, value = want if isinstance(want, tuple) else ("=", want)
            out = out & compare[how](F.col(name), F.lit(value))
    return out


def contains(column: str, part: str):
    """SQLite's LIKE '%part%': ASCII letters match in either case."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(fold(F.col(column)), fold(F.lit(part)))


@query("Q3_dynamic_conjunction", "SELECT c_custkey FROM customer WHERE 1 = 1 AND c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 ORDER BY c_custkey")
def q3(spark, sf):
    return table(spark, sf, "customer", matching({"c_mktsegment": "BUILDING", "c_acctbal": (">=", 1000), "c_nationkey": None})).select("c_custkey").orderBy("c_custkey")


@query("Q4_child_lookups", "SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_orderpriority) AS priorities, max(o_orderstatus) AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q4(spark, sf):
    child = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.size(F.collect_set("o_orderpriority")).cast("long").alias("priorities"), F.max("o_orderstatus").alias("status"))
    return table(spark, sf, "customer").select("c_custkey").join(child, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").fillna(0, ["orders", "priorities"])


@query("Q5_stats", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY c_mktsegment")
def q5(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@query("Q6_ordered_export", "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_name")
def q6(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_regionkey", "n_name")


@query("Q7_completeness_matrix", "SELECT c_custkey, CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END + CASE WHEN c_nationkey > 10 THEN 1 ELSE 0 END AS INT) AS flags FROM customer ORDER BY flags DESC, c_custkey")
def q7(spark, sf):
    flags = [F.col("c_acctbal") > 0, F.col("c_nationkey") > 10]
    return table(spark, sf, "customer").select("c_custkey", sum((f.cast("int") for f in flags), F.lit(0)).alias("flags")).orderBy(F.desc("flags"), "c_custkey")


@query("Q9_or_join", "SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3 OR r_name = 'ASIA'")
def q9(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.filter((F.col("n_nationkey") == 3) | (F.col("r_name") == "ASIA")).select("n_name", "r_name").distinct()


@query("Q10_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def q10(spark, sf):
    rich = table(spark, sf, "customer", "c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(rich).distinct()


@query("Q11_like_ignores_case", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def q11(spark, sf):
    return table(spark, sf, "part").filter(contains("p_name", "RED")).select("p_partkey", "p_name")


@query("Q12_catalog_search", "SELECT DISTINCT p_partkey, p_brand FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) k ON p_partkey = l_partkey WHERE p_type ILIKE '%econ%' OR l_partkey IS NOT NULL")
def q12(spark, sf):
    found = table(spark, sf, "lineitem", "l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("found", F.lit(True))
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type").join(found, "p_partkey", "left").filter(contains("p_type", "econ") | F.col("found")).select("p_partkey", "p_brand").distinct()


@query("C1_cte_top_region", "WITH t AS (SELECT n_regionkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey) SELECT r_name, n FROM t JOIN region ON k = r_regionkey WHERE n > 0")
def c1(spark, sf):
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n")
