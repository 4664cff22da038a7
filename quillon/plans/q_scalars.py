"""Scalar functions and text mining over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as C
from quillon.functions import special
from quillon.operators import text as X
from quillon.registry import query
from quillon.sources.tables import table


@query("S_string", "SELECT p_partkey, upper(trim(p_name)) AS up, replace(p_brand, 'Brand#', 'B') AS short, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, starts_with(p_name, 'red') AS is_red, string_split(p_name, ' ')[1] AS first_word FROM part")
def s_string(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("up"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("short"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.col("p_name").startswith("red").alias("is_red"), F.split("p_name", " ")[0].alias("first_word"))


@query("S_regex", r"SELECT p_partkey, CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) AS number, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, regexp_matches(p_name, '(?i)RING|widget') AS hit, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked FROM part")
def s_regex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("number"), F.regexp_count("p_name", F.lit("[aeiou]")).cast("long").alias("vowels"), F.col("p_name").rlike("(?i)RING|widget").alias("hit"), F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"))


@query("S_fuzzy_levenshtein", "SELECT p_partkey, levenshtein(p_name, lower(p_type))::INT AS distance, round(1 - levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS similarity FROM part")
def s_lev(spark, sf):
    d = F.levenshtein("p_name", F.lower("p_type"))
    return table(spark, sf, "part").select("p_partkey", d.alias("distance"), F.round(1 - d / F.greatest(F.length("p_name"), F.length("p_type")), 6).alias("similarity"))


@query("S_fuzzy_ratio")
def s_ratio(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.lower("p_type").alias("t"))
    return p.select("p_partkey", special.fuzzy_ratio("p_name", "t").alias("ratio"), special.fuzzy_partial("p_name", "t").alias("partial"), special.fuzzy_token_sort("p_name", "t").alias("token_sort"))


@query("S_hash", "SELECT doc_id, substr(sha256(concat_ws('|', lang, source, CAST(doc_id AS VARCHAR))), 1, 16) AS master_id, md5(text) AS content_md5 FROM documents")
def s_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.master_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("master_id"), F.md5("text").alias("content_md5"))


@query("S_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate)::INT AS y, dayofweek(o_orderdate)::INT + 1 AS dow, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::INT AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def s_date(spark, sf):
    d = "o_orderdate"
    return table(spark, sf, "orders").select("o_orderkey", F.to_date(d).alias("day"), F.year(d).alias("y"), F.dayofweek(d).alias("dow"), F.datediff(F.to_date(d), F.lit("1992-01-01")).alias("days"), F.date_format(d, "yyyy-MM").alias("ym"))


@query("S_math", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_extendedprice), 8) AS log1p, round(log2(l_quantity + 1), 8) AS lg2, round(asin(sqrt(l_discount)), 8) AS arcsine, floor(l_quantity / 7)::BIGINT AS fl, least(greatest(l_quantity, 10), 40) AS clipped, sign(l_quantity - 25)::DOUBLE AS sg FROM lineitem")
def s_math(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.log1p("l_extendedprice"), 8).alias("log1p"), F.round(F.log2(q + 1), 8).alias("lg2"), F.round(C.angular_sqrt(F.col("l_discount")), 8).alias("arcsine"), F.floor(q / 7).alias("fl"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clipped"), F.signum(q - 25).alias("sg"))


@query("S_circular", "SELECT event_id, round(least(abs(value * 7 - event_id) % 360, 360 - abs(value * 7 - event_id) % 360), 4) AS angle FROM events")
def s_circ(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(C.angular_error(F.col("value") * 7, F.col("event_id")), 4).alias("angle"))


@query("S_units", "SELECT event_id, round(value * 27.59, 4) AS nmol, round(CASE WHEN value < 5 THEN 5 / sqrt(2) ELSE value END, 6) AS detected, round(value * (1.024 - 1) / (1.02 - 1), 4) AS corrected FROM events")
def s_units(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(C.cortisol_nmol(v), 4).alias("nmol"), F.round(C.below_detection(v, F.lit(5.0)), 6).alias("detected"), F.round(C.gravity_corrected(v, F.lit(1.02)), 4).alias("corrected"))


@query("S_case_ladder", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'blue') OR contains(p_name, 'green') THEN 'cold' ELSE 'other' END AS category FROM part")
def s_case(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.when(n.contains("red"), "warm").when(n.contains("blue") | n.contains("green"), "cold").otherwise("other").alias("category"))


@query("S_signal_detection")
def s_dprime(spark, sf):
    e = table(spark, sf, "lineitem")
    signal = F.col("l_returnflag") == "R"
    yes = F.col("l_quantity") > 25
    rate = lambda c: C.clipped_rate(F.count_if(c & yes) / F.count_if(c))
    g = e.groupBy("l_suppkey").agg(rate(signal).alias("hit"), rate(~signal).alias("false_alarm")).withColumns({"zh": special.normal_inverse("hit"), "zf": special.normal_inverse("false_alarm")})
    return g.select("l_suppkey", "hit", "false_alarm", (F.col("zh") - F.col("zf")).alias("d_prime"), (-(F.col("zh") + F.col("zf")) / 2).alias("criterion"))


@query("S_psychometrics", "SELECT l_suppkey, round(max(l_linenumber) * (2 * avg((l_quantity > 20)::INT) - 1), 6) AS cowan_k, round(avg(1 - abs(l_quantity - l_linenumber * 7) / l_quantity), 6) AS counting FROM lineitem GROUP BY 1")
def s_psy(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(C.cowan_k(F.max("l_linenumber"), F.avg((F.col("l_quantity") > 20).cast("int"))), 6).alias("cowan_k"), F.round(F.avg(C.heartbeat_accuracy(F.col("l_quantity"), F.col("l_linenumber") * 7)), 6).alias("counting"))


@query("S_array_set", "SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds, len(list_distinct(list(event_type)))::INT AS n FROM events GROUP BY 1")
def s_array(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds")).withColumn("n", F.size("kinds"))


@query("S_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS k7 FROM events")
def s_json(spark, sf):
    k = F.from_json("props", "k INT")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k % 7).alias("k7"))


@query("S_risk_score", "SELECT o_orderkey, least((o_totalprice > 100000)::INT * 3 + (o_totalprice > 300000)::INT * 4 + (o_orderpriority = '1-URGENT')::INT * 5, 10) AS risk FROM orders")
def s_risk(spark, sf):
    p = F.col("o_totalprice")
    score = (p > 100000).cast("int") * 3 + (p > 300000).cast("int") * 4 + (F.col("o_orderpriority") == "1-URGENT").cast("int") * 5
    return table(spark, sf, "orders").select("o_orderkey", F.least(score, F.lit(10)).alias("risk"))


@query("S_e_value", "WITH r AS (SELECT l_suppkey, (avg((l_quantity > 25)::INT) FILTER (WHERE l_returnflag = 'R')) / (avg((l_quantity > 25)::INT) FILTER (WHERE l_returnflag <> 'R')) AS rr FROM lineitem GROUP BY 1), q AS (SELECT l_suppkey, CASE WHEN rr < 1 THEN 1 / rr ELSE rr END AS r FROM r) SELECT l_suppkey, round(r + sqrt(r * (r - 1)), 6) AS e_value FROM q")
def s_evalue(spark, sf):
    hit, case = (F.col("l_quantity") > 25).cast("int"), F.col("l_returnflag") == "R"
    r = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg(F.when(case, hit)) / F.avg(F.when(~case, hit))).alias("rr"))
    return r.select("l_suppkey", F.round(C.e_value(F.col("rr")), 6).alias("e_value"))


@query(
    "M71_concentration_parser",
    r"""WITH c AS (SELECT event_id, event_id % 5 AS m, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT event_id, CASE m WHEN 0 THEN v + 1.0 WHEN 4 THEN NULL ELSE v END::DOUBLE AS value, CASE m WHEN 0 THEN 0.5 WHEN 1 THEN 3.0 END::DOUBLE AS spread FROM c""",
)
def m71(spark, sf):
    v, m = F.floor("value").cast("string"), F.col("event_id") % 5
    text = F.when(m == 0, F.concat(v, F.lit("-"), (F.floor("value") + 2).cast("string"))).when(m == 1, F.concat(v, F.lit(" ± 3"))).when(m == 2, F.concat(F.lit("<"), v)).when(m == 3, v).otherwise("n/a")
    value, spread = C.concentration(F.col("t"))
    return table(spark, sf, "events").select("event_id", text.alias("t")).select("event_id", value.alias("value"), spread.alias("spread"))


_MENTIONS = {"email": X.EMAIL, "phone": r"\(\d{3}\) \d{3}-\d{4}", "short_words": r"\b[a-z]{2}\b"}


@query(
    "M61_mentions",
    r"""SELECT doc_id, 'email' AS kind, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS n FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')
UNION ALL SELECT doc_id, 'phone', len(list_distinct(regexp_extract_all(text, '\(\d{3}\) \d{3}-\d{4}'))) FROM documents WHERE regexp_matches(text, '\(\d{3}\) \d{3}-\d{4}')""",
)
def m61(spark, sf):
    two = {k: _MENTIONS[k] for k in ("email", "phone")}
    return X.mentions(table(spark, sf, "documents"), "doc_id", "text", two).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("M62_relevance", "SELECT doc_id, CASE WHEN contains(lower(text), '$$$') THEN 0 ELSE contains(lower(text), 'the')::INT * 2 + contains(lower(text), 'der')::INT * 2 + regexp_matches(text, '(?i)(^|\\s)(la|le)(\\s|$)')::INT END AS score FROM documents")
def m62(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.relevance(F.col("text"), ["the", "der"], [r"(^|\s)(la|le)(\s|$)"], ["$$$"]).alias("score"))


@query("SRC16_html_links", """SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*?href="([^"]*)"', 1)) AS links, sha256(html) AS content_hash FROM pages""")
def src16(spark, sf):
    p = table(spark, sf, "pages")
    n = X.html_links(p, "page_id", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return p.select("page_id", X.content_hash(F.col("html")).alias("content_hash")).join(n, "page_id", "left").select("page_id", F.coalesce("links", F.lit(0)).alias("links"), "content_hash")


@query("ST1_change_detection", "WITH h AS (SELECT conv_id, turn, role, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn, role) AS p FROM conversations) SELECT conv_id, turn, role, p IS NULL OR p <> h AS changed FROM h")
def st1(spark, sf):
    from pyspark.sql import Window

    h = F.md5("text")
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    c = table(spark, sf, "conversations").withColumn("h", h).withColumn("p", F.lag("h").over(w))
    return c.select("conv_id", "turn", "role", (F.col("p").isNull() | (F.col("p") != F.col("h"))).alias("changed"))


@query("ST2_dedupe_seen", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def st2(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("ST3_sliding_window", "SELECT w AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def st3(spark, sf):
    w = F.window("ts", "2 hours", "1 hour")
    return table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


@query("ST4_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k")
def st4(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


@query("ST5_daily_digest", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS worst FROM events GROUP BY 1")
def st5(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("worst"))
