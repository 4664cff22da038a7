"""Joins over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import joins as J
from quillon.registry import query
from quillon.sources.tables import table


@query("J1_left_equi", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j1(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "J2_left_chain",
    """SELECT c_custkey, coalesce(o.n, 0) AS n_orders, round(coalesce(o.total, 0), 2) AS total, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) n, sum(o_totalprice) total FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def j2(spark, sf):
    t = lambda n: table(spark, sf, n)
    per = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    out = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "n_name", "r_name")


@query(
    "J3_outer_many",
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT k, a.n AS n, b.n AS n_1, c.n AS n_2 FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""",
)
def j3(spark, sf):
    l = table(spark, sf, "lineitem")
    return J.outer_all([l.filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n")) for f in "ARN"], "k")


@query("J5_effect_pairs", "WITH e AS (SELECT l_returnflag f, l_suppkey s, avg(l_extendedprice) m FROM lineitem GROUP BY ALL) SELECT a.s AS feature, round(a.m, 4) AS effect_ref, round(b.m, 4) AS effect_ext FROM e a JOIN e b ON a.s = b.s AND a.f = 'A' AND b.f = 'R'")
def j5(spark, sf):
    l = table(spark, sf, "lineitem")
    of = lambda f, n: l.filter(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("feature")).agg(F.round(F.avg("l_extendedprice"), 4).alias(n))
    return of("A", "effect_ref").join(of("R", "effect_ext"), "feature")


@query(
    "J6_specific_features",
    """WITH a AS (SELECT l_partkey k, avg(l_discount) m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey k, avg(l_discount) m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS feature, coalesce(a.m < 0.04, false) AS sig_a, coalesce(b.m < 0.04, false) AS sig_b FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.m < 0.04, false) <> coalesce(b.m < 0.04, false)""",
)
def j6(spark, sf):
    l = table(spark, sf, "lineitem")
    of = lambda f, n: l.filter(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("feature")).agg((F.avg("l_discount") < 0.04).alias(n))
    both = of("A", "sig_a").join(of("R", "sig_b"), "feature", "outer").fillna(False)
    return both.filter("sig_a <> sig_b").select("feature", "sig_a", "sig_b")


@query("J8_left_other_names", "SELECT p_partkey, l_orderkey FROM part LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def j8(spark, sf):
    first = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey"))
    return table(spark, sf, "part").join(first, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "l_orderkey")


@query("J9_demographic_match", "SELECT a.c_custkey AS left_id, b.s_suppkey AS right_id FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND floor(a.c_acctbal / 100) = floor(b.s_acctbal / 100)")
def j9(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("left_id"), F.col("c_nationkey").alias("n"), F.floor(F.col("c_acctbal") / 100).alias("b"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("right_id"), F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 100).alias("b"))
    return a.join(b, ["n", "b"]).select("left_id", "right_id")


@query(
    "J10_fuzzy_match",
    """WITH d AS (SELECT DISTINCT p_brand, p_name FROM part), s AS (SELECT a.p_brand, a.p_name AS l, b.p_name AS r, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE AS score FROM d a JOIN d b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name)
SELECT p_brand, l AS name, r AS match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, l ORDER BY score DESC, r) AS k FROM s WHERE score >= 0.3) WHERE k = 1""",
)
def j10(spark, sf):
    """Distinct names only, so a block is bounded by its vocabulary."""
    d = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    a = d.select(F.struct("p_brand", "p_name").alias("l"), F.col("p_name").alias("ln"), F.col("p_brand").alias("lb"))
    b = d.select(F.col("p_name").alias("match"), F.col("p_name").alias("rn"), F.col("p_brand").alias("rb"))
    return J.best_fuzzy(a, b, "l", "ln", "match", "rn", F.col("lb"), F.col("rb"), 0.3, distinct=True).select("l.p_brand", F.col("l.p_name").alias("name"), "match", F.round("score", 6).alias("score"))


@query("J12_daily_left", "SELECT d.day, d.n, s.errors FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) d LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1) s USING (day)")
def j12(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    bad = e.filter("event_type = 'error' AND value > 100").groupBy("day").agg(F.count(F.lit(1)).alias("errors"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("n")).join(bad, "day", "left")


_GRID = "(k * 37 % 700) / 100.0 + 30 AS lat, (k * 91 % 1100) / 100.0 - 90 AS lon"


@query(
    "J14_radius",
    f"""WITH c AS (SELECT c_custkey, {_GRID.replace("k *", "c_custkey *")} FROM customer), s AS (SELECT s_suppkey, {_GRID.replace("k *", "s_suppkey *")} FROM supplier)
SELECT c_custkey, s_suppkey FROM c, s WHERE 2 * 3959 * asin(sqrt(least(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2), 1.0))) <= 25""",
)
def j14(spark, sf):
    at = lambda df, k: df.select(k, (F.col(k) * 37 % 700 / 100.0 + 30).alias("lat"), (F.col(k) * 91 % 1100 / 100.0 - 90).alias("lon"))
    return J.radius_join(at(table(spark, sf, "customer"), "c_custkey"), at(table(spark, sf, "supplier"), "s_suppkey"), "lat", "lon", 25.0).select("c_custkey", "s_suppkey")


@query(
    "J15_interval_overlap",
    """WITH g AS (SELECT p_partkey AS gene, p_size % 5 AS chr, p_partkey * 50 AS s, p_partkey * 50 + p_size * 10 AS e FROM part), v AS (SELECT s_suppkey AS region, s_nationkey % 5 AS chr, s_suppkey * 700 AS s, s_suppkey * 700 + 300 AS e FROM supplier)
SELECT region, gene FROM v JOIN g ON v.chr = g.chr AND v.s - 50 <= g.e AND v.e + 50 >= g.s""",
)
def j15(spark, sf):
    g = table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 5).alias("chr"), (F.col("p_partkey") * 50).alias("g_s"), (F.col("p_partkey") * 50 + F.col("p_size") * 10).alias("g_e"))
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("region"), (F.col("s_nationkey") % 5).alias("chr"), (F.col("s_suppkey") * 700).alias("v_s"), (F.col("s_suppkey") * 700 + 300).alias("v_e"))
    return J.overlap_join(v, g, "chr", "v_s", "v_e", "g_s", "g_e", 50, 1000.0).select("region", "gene")


_STAGES = [("early", 0, 5), ("middle", 6, 14), ("late", 15, None)]


@query(
    "J16_life_stage",
    """WITH f AS (SELECT *, date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)) AS age FROM events), w(stage, a, b) AS (VALUES ('early', 0, 5), ('middle', 6, 14), ('late', 15, NULL))
SELECT user_id, stage, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM f JOIN w ON age >= a AND (b IS NULL OR age <= b) GROUP BY ALL""",
)
def j16(spark, sf):
    e = table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("_first"))
    stages = spark.createDataFrame(_STAGES, "stage string, a int, b int")
    age = F.datediff(F.to_date("ts"), "_first")
    hit = (age >= F.col("a")) & (F.col("b").isNull() | (age <= F.col("b")))
    return e.join(first, "user_id").join(F.broadcast(stages), hit).groupBy("user_id", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("peak"))


@query("J17_first_year_bins", "WITH f AS (SELECT o_custkey, floor(date_diff('day', CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE), CAST(o_orderdate AS DATE)) / 365.25)::BIGINT AS year FROM orders) SELECT o_custkey, year, count(*) AS n FROM f GROUP BY ALL")
def j17(spark, sf):
    o = table(spark, sf, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("_f"))
    return o.join(first, "o_custkey").groupBy("o_custkey", F.floor(F.datediff("o_orderdate", "_f") / 365.25).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("J18_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j18(spark, sf):
    cases = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(cases, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(
    "J19_comorbid",
    """WITH a AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus = 'P')
SELECT k AS id, 'both' AS grp FROM a SEMI JOIN b USING (k) UNION ALL SELECT k, 'first_only' FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'second_only' FROM b ANTI JOIN a USING (k)""",
)
def j19(spark, sf):
    o = table(spark, sf, "orders")
    marks = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.max(F.col("o_orderstatus") == "P").alias("b"))
    return marks.filter("a or b").select("id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first_only").otherwise("second_only").alias("grp"))


@query(
    "J20_presence",
    """WITH k AS (SELECT o_custkey AS id, true AS a, false AS b, false AS c FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT c_custkey, false, true, false FROM customer WHERE c_acctbal < 500 UNION ALL SELECT user_id, false, false, true FROM events)
SELECT id, bool_or(a) AS has_orders, bool_or(b) AS has_customer, bool_or(c) AS has_events FROM k GROUP BY 1""",
)
def j20(spark, sf):
    return J.presence({"orders": table(spark, sf, "orders", "o_totalprice > 400000").select(F.col("o_custkey").alias("id")), "customer": table(spark, sf, "customer", "c_acctbal < 500").select(F.col("c_custkey").alias("id")), "events": table(spark, sf, "events").select(F.col("user_id").alias("id"))}, "id")


@query(
    "J21_nearest_centroid",
    """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL), d AS (SELECT x.vec_id, c.label, sum((x.v - c.m) * (x.v - c.m)) AS d FROM x JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, arg_min(label, d) AS nearest, round(sqrt(min(d)), 5) AS distance FROM d GROUP BY 1""",
)
def j21(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    long = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    cents = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("x"))
    return J.nearest_centroid(e.select("vec_id", "x"), cents, "vec_id", "x", "label").withColumn("distance", F.round("distance", 5))


@query("J23_co_assignment", "SELECT a.vec_id AS i, count(*) AS together, min(b.vec_id) AS first FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1")
def j23(spark, sf):
    """A query set (every hundredth vector) against all rows; the pairs are counted, not kept."""
    e = table(spark, sf, "embeddings").select("label", "vec_id")
    q = e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "i")
    return q.join(e, "label").filter("i <> vec_id").groupBy("i").agg(F.count(F.lit(1)).alias("together"), F.min("vec_id").alias("first"))


@query("J24_or_predicate", "SELECT DISTINCT p_partkey, p_name FROM part LEFT JOIN lineitem ON p_partkey = l_partkey WHERE p_brand = 'Brand#3' OR l_quantity >= 50")
def j24(spark, sf):
    # The alternatives are two plans: one needs no join, the other a semi-join.
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem", "l_quantity >= 50")
    return p.filter("p_brand = 'Brand#3'").unionAll(p.join(l, F.col("p_partkey") == F.col("l_partkey"), "left_semi")).select("p_partkey", "p_name").distinct()


@query("J25_update", "SELECT c_custkey, coalesce(o.best, c_acctbal) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey")
def j25(spark, sf):
    new = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    return table(spark, sf, "customer").join(new, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("best", "c_acctbal").alias("value"))


@query(
    "J26_nearest_visit",
    """WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT a.o_orderkey AS l, b.o_orderkey AS r, abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) AS gap FROM a JOIN b ON a.o_custkey = b.o_custkey)
SELECT l AS left_order, r AS right_order, gap AS gap_days FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY gap, r) k FROM m WHERE gap <= 30) WHERE k = 1""",
)
def j26(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("left_order"), F.col("o_orderdate").alias("lt"))
    b = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("right_order"), F.col("o_orderdate").alias("rt"))
    return J.nearest_in_window(a, b, "c", "lt", "rt", 30, "right_order").select("left_order", "right_order", F.col("gap_days").cast("long").alias("gap_days"))


@query("J26_as_of", "SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def j26b(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return J.as_of(e.filter("event_type = 'click'").drop("value", "event_type"), e.filter("event_type = 'error'").drop("event_type"), "user_id", "ts", "value", "event_id").select("event_id", "last_value")
