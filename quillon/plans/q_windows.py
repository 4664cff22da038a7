"""Window operators over the standard tables: users are participants, events their epochs, orders their visits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import semantics as S
from quillon.operators import stats as M
from quillon.operators import windows as W
from quillon.registry import query
from quillon.sources.tables import table


def _hourly(spark, sf):
    e = table(spark, sf, "events")
    return W.resample(e, ["user_id"], "ts", 60, [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")])


_HOURLY = """b AS (SELECT user_id, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS slot, value FROM events), a AS (SELECT user_id, slot, avg(value) AS mean, stddev_samp(value) AS std, max(value) AS peak, count(*) AS n FROM b GROUP BY ALL),
sp AS (SELECT user_id, unnest(generate_series(min(slot), max(slot), 3600)) AS slot FROM b GROUP BY 1), h AS (SELECT sp.user_id, sp.slot, a.mean, a.std, a.peak, a.n FROM sp LEFT JOIN a USING (user_id, slot))"""


@query("W1_resample", f"WITH {_HOURLY} SELECT user_id, slot, round(mean, 6) AS mean, round(std, 6) AS std, peak, n, CASE WHEN mean < 10 THEN 'sedentary' WHEN mean BETWEEN 15 AND 40 THEN 'moderate' WHEN mean > 40 THEN 'vigorous' END AS intensity FROM h")
def w1(spark, sf):
    m = F.col("mean")
    return _hourly(spark, sf).select("user_id", "slot", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "peak", "n", F.when(m < 10, "sedentary").when(m.between(15, 40), "moderate").when(m > 40, "vigorous").alias("intensity"))


@query(
    "W2_profile_rolling",
    """WITH p AS (SELECT event_type, hour(ts) AS h, avg(value) AS m FROM events GROUP BY ALL), r AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(m) OVER w END AS m10 FROM p WINDOW w AS (PARTITION BY event_type ORDER BY h ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
SELECT event_type, h AS hour, round(m, 6) AS mean, round(m10, 6) AS rolling10 FROM r""",
)
def w2(spark, sf):
    p = table(spark, sf, "events").groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.avg("value").alias("m"))
    return p.select("event_type", "hour", F.round("m", 6).alias("mean"), F.round(W.full_frame(F.avg("m"), ["event_type"], ["hour"], -5, 4), 6).alias("rolling10"))


@query(
    "W3_interdaily_stability",
    """WITH g AS (SELECT user_id, hour(ts) h, avg(value) m, var_samp(value) v FROM events GROUP BY ALL) SELECT user_id, round(1 - avg(v) / nullif(var_samp(m), 0), 4) AS stability FROM g GROUP BY 1""",
)
def w3(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    return g.groupBy("user_id").agg(F.round(1 - F.avg("v") / F.nullif(F.var_samp("m"), F.lit(0.0)), 4).alias("stability"))


_LAG = "d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv FROM events)"


@query("W4_intradaily_variability", f"WITH {_LAG} SELECT user_id, round(avg(abs(dv)) / avg(value), 6) AS iv FROM d GROUP BY 1")
def w4(spark, sf):
    d = table(spark, sf, "events").withColumn("dv", F.col("value") - F.lag("value").over(W.by(["user_id"], ["ts", "event_id"])))
    return d.groupBy("user_id").agg(F.round(F.avg(F.abs("dv")) / F.avg("value"), 6).alias("iv"))


@query(
    "W5_rolling_cv",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL) SELECT event_type, day, round(CASE WHEN count(*) OVER w = 7 THEN stddev_samp(v) OVER w / avg(v) OVER w END, 6) AS cv FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def w5(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    cv = W.full_frame(F.stddev_samp("v"), ["event_type"], ["day"], -6, 0) / W.full_frame(F.avg("v"), ["event_type"], ["day"], -6, 0)
    return d.select("event_type", "day", F.round(cv, 6).alias("cv"))


_ISLANDS = """m AS (SELECT user_id, event_id, value < 15 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, f ORDER BY event_id) AS g FROM m),
i AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r WHERE f GROUP BY user_id, g)"""


@query("W6_sleep_bouts", f"WITH {_ISLANDS} SELECT user_id, max(length) AS longest, count(*) AS bouts, sum(length)::BIGINT AS asleep, arg_min(first, (-length, first)) AS longest_start FROM i GROUP BY 1")
def w6(spark, sf):
    i = W.islands(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("value") < 15)
    return i.groupBy("user_id").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("bouts"), F.sum("length").alias("asleep"), F.min_by("first", F.struct(-F.col("length"), F.col("first"))).alias("longest_start"))


@query(
    "W7_sadeh",
    """WITH f AS (SELECT event_id, list(value) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
s AS (SELECT event_id, 7.601 - 0.065 * len(list_filter(x, lambda v: v >= 50)) - 0.056 * list_avg(x) - 0.703 * list_stddev_pop(x) - 1.08 * ln(x[least(6, len(x))] + 1) AS score FROM f)
SELECT event_id, round(score, 6) AS sadeh, score >= 0 AS asleep FROM s""",
)
def w7(spark, sf):
    return W.sleep_scores(table(spark, sf, "events"), ["user_id"], ["event_id"], "value").select("event_id", F.round("sadeh", 6).alias("sadeh"), F.col("sadeh_asleep").alias("asleep"))


@query(
    "W8_cole_kripke",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), p AS (SELECT unnest(range(8)) AS j, unnest([0.00001, 0.04, 1.0, 0.04, 0.0001, 0.0001, 0.0004, 0.02]::DOUBLE[]) AS weight),
a AS (SELECT x.event_id, sum(p.weight * coalesce(y.value, 0)) / 100 AS d FROM n x CROSS JOIN p LEFT JOIN n y ON y.user_id = x.user_id AND y.i = x.i + p.j - 2 GROUP BY 1)
SELECT event_id, round(1 / (1 + exp(0.37 - 0.73 * d)), 6) AS cole, 1 / (1 + exp(0.37 - 0.73 * d)) >= 0.5 AS asleep FROM a""",
)
def w8(spark, sf):
    return W.sleep_scores(table(spark, sf, "events"), ["user_id"], ["event_id"], "value").select("event_id", F.round("cole", 6).alias("cole"), F.col("cole_asleep").alias("asleep"))


@query("W9_threshold_sleep", "WITH t AS (SELECT user_id, quantile_cont(value, 0.2) q FROM events GROUP BY 1) SELECT user_id, count(*) FILTER (WHERE value < q) AS asleep FROM events JOIN t USING (user_id) GROUP BY 1")
def w9(spark, sf):
    e = table(spark, sf, "events")
    t = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.2)).alias("q"))
    return e.join(t, "user_id").groupBy("user_id").agg(F.count_if(F.col("value") < F.col("q")).alias("asleep"))


# Epochs of 60 minutes stand for the events, which lie hours apart; 45 and less is asleep.
_PERIODS = """n AS (SELECT user_id, event_id, value, value < 45 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), t AS (SELECT *, lag(f) OVER (PARTITION BY user_id ORDER BY n) AS before FROM n),
onsets AS (SELECT user_id, n AS onset FROM t WHERE f AND NOT before), offsets AS (SELECT user_id, n AS off FROM t WHERE NOT f AND before), p AS (SELECT user_id, onset, min(off) AS off FROM onsets JOIN offsets USING (user_id) WHERE off > onset GROUP BY ALL)"""


@query("W10_long_periods", f"WITH {_PERIODS} SELECT user_id, onset, off AS offset, (off - onset) * 60.0::DOUBLE AS minutes FROM p WHERE (off - onset) * 60 >= 180")
def w10(spark, sf):
    return W.sleep_periods(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("value") < 45, 60.0)


@query(
    "W11_sleep_quality",
    f"""WITH {_PERIODS}, m AS (SELECT user_id, arg_min(onset, (onset - off, onset)) AS onset, arg_min(off, (onset - off, onset)) AS off FROM p WHERE (off - onset) * 60 >= 180 GROUP BY 1), q AS (SELECT user_id, quantile_cont(value, 0.9) AS top FROM events GROUP BY 1)
SELECT user_id, count(*) * 60.0::DOUBLE AS tst, count(*) * 60.0::DOUBLE AS tib, 100.0::DOUBLE AS se, 0.0::DOUBLE AS waso, 0.0::DOUBLE AS sol, 0::BIGINT AS awakenings, round(count(*) FILTER (WHERE value > top) / count(*), 6) AS sfi FROM m JOIN n USING (user_id) JOIN q USING (user_id) WHERE n >= onset AND n < off GROUP BY 1""",
)
def w11(spark, sf):
    q = W.sleep_quality(table(spark, sf, "events"), ["user_id"], ["event_id"], "value", F.col("value") < 45, 60.0)
    return q.select("user_id", "tst", "tib", "se", "waso", "sol", "awakenings", F.round("sfi", 6).alias("sfi"))


@query(
    "W12_rhythm",
    """WITH h AS (SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS slot, hour(date_trunc('hour', any_value(ts))) AS hr, avg(value) AS v FROM events GROUP BY event_type, date_trunc('hour', ts)), d AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type ORDER BY slot) dv,
CASE WHEN count(*) OVER a = 10 THEN avg(v) OVER a END m10, CASE WHEN count(*) OVER b = 5 THEN avg(v) OVER b END l5 FROM h WINDOW a AS (PARTITION BY event_type ORDER BY slot ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), b AS (PARTITION BY event_type ORDER BY slot ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT event_type, count(*) n, avg(v) m, var_pop(v) * count(*) ss, sum(dv * dv) dd, count(dv) nd, max(m10) m10, min(l5) l5 FROM d GROUP BY 1), g AS (SELECT event_type, hr, avg(v) hm FROM d GROUP BY ALL)
SELECT g.event_type, round(any_value(n) * sum((hm - m) * (hm - m)) / (count(*) * any_value(ss)), 6) AS "is", round(any_value(n * dd / (nd * ss)), 6) AS iv, round(any_value(m10), 6) AS m10, round(any_value(l5), 6) AS l5, round(any_value((m10 - l5) / (m10 + l5)), 6) AS ra FROM g JOIN t USING (event_type) GROUP BY 1""",
)
def w12(spark, sf):
    e = table(spark, sf, "events")
    h = W.resample(e, ["event_type"], "ts", 60, [F.avg("value").alias("v")], fill_gaps=False).withColumn("hr", F.pmod(F.col("slot") / 3600, F.lit(24)).cast("long"))
    r = W.rhythm(h, ["event_type"], "hr", "slot", "v")
    return r.select("event_type", *(F.round(c, 6).alias(c) for c in ("is", "iv", "m10", "l5", "ra")))


@query(
    "W13_hrv_time_domain",
    f"WITH {_LAG} SELECT user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sdnn, round(sqrt(avg(dv * dv)), 6) AS rmssd, round(stddev_samp(dv), 6) AS sdsd, round(count(*) FILTER (WHERE abs(dv) > 50) / count(dv) * 100, 6) AS pnn50, round(count(*) FILTER (WHERE abs(dv) > 20) / count(dv) * 100, 6) AS pnn20, round(stddev_samp(value) / avg(value), 6) AS cv FROM d GROUP BY 1",
)
def w13(spark, sf):
    s = W.successive(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    return s.select("user_id", *(F.round(c, 6).alias(c) for c in ("mean", "sdnn", "rmssd", "sdsd", "pnn50", "pnn20", "cv")))


@query("W14_poincare", f"WITH {_LAG} SELECT user_id, round(sqrt(var_pop(dv) / 2), 6) AS sd1, round(sqrt(greatest(2 * var_pop(value) - var_pop(dv) / 2, 0)), 6) AS sd2 FROM d GROUP BY 1")
def w14(spark, sf):
    return W.successive(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("sd1", 6).alias("sd1"), F.round("sd2", 6).alias("sd2"))


@query(
    "W15_enrichment",
    """WITH s AS (SELECT l_partkey AS gene, avg(l_discount) - 0.05 AS score FROM lineitem GROUP BY 1), sets AS (SELECT DISTINCT p_brand AS brand FROM part), x AS (SELECT brand, gene, score, p_brand = brand AS member FROM s JOIN part ON p_partkey = gene CROSS JOIN sets),
r AS (SELECT *, row_number() OVER o AS n, sum(CASE WHEN member THEN abs(score) ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) / sum(CASE WHEN member THEN abs(score) ELSE 0 END) OVER (PARTITION BY brand) - sum((NOT member)::INT) OVER (o ROWS UNBOUNDED PRECEDING) / sum((NOT member)::INT) OVER (PARTITION BY brand) AS run FROM x WINDOW o AS (PARTITION BY brand ORDER BY score DESC, gene)),
k AS (SELECT brand, arg_max(run, abs(run)) AS es, arg_max(n, abs(run)) AS peak FROM r GROUP BY 1) SELECT brand, round(any_value(es), 6) AS es, count(*) FILTER (WHERE member AND CASE WHEN es >= 0 THEN n <= peak ELSE n > peak END) AS leading FROM r JOIN k USING (brand) GROUP BY 1""",
)
def w15(spark, sf):
    part = table(spark, sf, "part")
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg((F.avg("l_discount") - 0.05).alias("score"))
    sets = part.select(F.col("p_brand").alias("brand")).distinct()
    x = s.join(part, F.col("gene") == F.col("p_partkey")).crossJoin(sets).withColumn("member", F.col("p_brand") == F.col("brand"))
    return W.enrichment(x, ["brand"], "score", "member", "gene").select("brand", F.round("es", 6).alias("es"), "leading")


@query("M33_preranked")
def m33_preranked(spark, sf):
    """Normalised enrichment, permutation p and FDR of each brand's parts among all parts."""
    part = table(spark, sf, "part")
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg((F.avg("l_discount") - 0.05).alias("score"))
    return W.preranked(s.join(part, F.col("gene") == F.col("p_partkey")).select("gene", "score", F.col("p_brand").alias("set")), "gene", "score", "set", 100)


@query(
    "W16_bh_fdr",
    """WITH p AS (SELECT l_returnflag AS f, l_suppkey AS k, exp(-abs(avg(l_discount) - 0.05) * 1000) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, p * count(*) OVER (PARTITION BY f) / row_number() OVER (PARTITION BY f ORDER BY p, k) AS raw FROM p)
SELECT f, k, round(p, 8) AS p, round(least(min(raw) OVER (PARTITION BY f ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS q FROM r""",
)
def w16(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_suppkey").alias("k")).agg(F.exp(-F.abs(F.avg("l_discount") - 0.05) * 1000).alias("p"))
    return S.with_fdr(p, ["f"], "p", "k").select("f", "k", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query("W17_average_rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value DESC) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events")
def w17(spark, sf):
    return table(spark, sf, "events").select("event_id", S.average_rank(["event_type"], "value", descending=True).alias("r"))


@query("W18_ordinal_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS ordinal FROM events")
def w18(spark, sf):
    return W.ranks(table(spark, sf, "events"), ["user_id"], "value", "event_id").select("event_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("W19_turn_gaps", "WITH t AS (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) - (value * 60000000)::BIGINT AS gap FROM events) SELECT user_id, count(*) FILTER (WHERE gap >= 0) AS gaps, count(*) FILTER (WHERE gap < 0) AS overlaps FROM t GROUP BY 1")
def w19(spark, sf):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = us(F.lead("ts").over(W.by(["user_id"], ["ts", "event_id"]))) - us(F.col("ts")) - F.round(F.col("value") * 60000000).cast("long")
    t = table(spark, sf, "events").select("user_id", gap.alias("gap"))
    return t.groupBy("user_id").agg(F.count_if(F.col("gap") >= 0).alias("gaps"), F.count_if(F.col("gap") < 0).alias("overlaps"))


@query("W20_widest_gap", "WITH g AS (SELECT l_suppkey, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS g, lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS below FROM lineitem) SELECT l_suppkey, round(max(g), 4) AS gap, arg_max(below, g) AS below FROM g WHERE below IS NOT NULL GROUP BY 1")
def w20(spark, sf):
    return W.widest_gap(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice").select("l_suppkey", F.round("gap", 4).alias("gap"), "below")


@query(
    "W21_threshold",
    """WITH a AS (SELECT l_suppkey AS k, l_linenumber AS lv, avg((l_quantity > 24)::INT) AS acc FROM lineitem GROUP BY ALL), p AS (SELECT *, lag(lv) OVER w pl, lag(acc) OVER w pa FROM a WINDOW w AS (PARTITION BY k ORDER BY lv)), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lv) rn FROM p WHERE acc >= 0.55)
SELECT k, round(CASE WHEN pl IS NULL OR pa >= 0.55 THEN lv ELSE pl + (0.55 - pa) / (acc - pa) * (lv - pl) END, 6) AS threshold FROM f WHERE rn = 1""",
)
def w21(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("lv")).agg(F.avg((F.col("l_quantity") > 24).cast("int")).alias("acc"))
    return W.threshold_crossing(a, ["k"], "lv", "acc", 0.55).withColumn("threshold", F.round(F.col("threshold").cast("double"), 6))


@query(
    "W22_curve_area",
    """WITH h AS (SELECT user_id, hour(ts)::DOUBLE AS x, avg(value) AS y FROM events GROUP BY ALL), d AS (SELECT *, lag(x) OVER w px, lag(y) OVER w py FROM h WINDOW w AS (PARTITION BY user_id ORDER BY x)) SELECT user_id, round(arg_min(y, x), 6) AS first, round(arg_max(y, x), 6) AS last, round(regr_slope(y, x), 6) AS slope, round(sum((x - px) * (y + py) / 2), 2) AS auc FROM d GROUP BY 1""",
)
def w22(spark, sf):
    h = table(spark, sf, "events").groupBy("user_id", F.hour("ts").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return W.trapezoid(h, ["user_id"], "x", "y").select("user_id", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round("slope", 6).alias("slope"), F.round("auc", 2).alias("auc"))


@query("W24_years_since_first", "SELECT o_orderkey, round(date_diff('day', CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE), CAST(o_orderdate AS DATE)) / 365.25, 6) AS years FROM orders")
def w24(spark, sf):
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.datediff("o_orderdate", first) / 365.25, 6).alias("years"))


@query(
    "W26_explained_variance",
    """WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_tax * 1000) AS b, covar_samp(l_quantity, l_tax * 1000) AS c FROM lineitem), e AS (SELECT (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS top, a + b AS total FROM c)
SELECT 1::BIGINT AS component, round(top / total, 6) AS share FROM e UNION ALL SELECT 2, 1.0 FROM e""",
)
def w26(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 1000).alias("tax"))
    return M.explained_variance(d, ["l_quantity", "tax"]).select("component", F.round("cumulative", 6).alias("share"))
