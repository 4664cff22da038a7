"""Sparse partial correlations and knockoffs over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import sparse as S
from quillon.operators import stability
from quillon.plans.q_clusters import LETTERS, _letters
from quillon.registry import query
from quillon.sources.tables import table


def _wide(spark, sf):
    return _letters(spark, sf).select("doc_id", (F.col("lang") == "en").cast("double").alias("english"), *(F.col("x")[i].alias(c) for i, c in enumerate(LETTERS)))


@query("M46_graphical_lasso")
def network(spark, sf):
    """Which letters' shares go together once all other letters are known."""
    return S.partial_correlations(_wide(spark, sf), "doc_id", list(LETTERS), [0.01, 0.03, 0.1, 0.3, 1.0])


@query("M22_knockoffs")
def selected(spark, sf):
    """Letters that tell English from other languages, at a false discovery rate of one in two."""
    return S.knockoff_select(S.knockoff_statistics(_wide(spark, sf), "doc_id", list(LETTERS), "english"), 0.5)


@query("M22_stability_lasso")
def stable(spark, sf):
    """How often a lasso on half of all documents needs a letter to tell English from other languages."""
    return stability.stability_selection(_wide(spark, sf), "doc_id", list(LETTERS), "english", 20, alphas=10)


_SQL_W = "w AS (SELECT p_brand AS feature, (round(avg(l_discount), 6) - 0.05) * 10000 AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


@query(
    "M22_knockoff_threshold",
    f"WITH {_SQL_W}, e AS (SELECT a.w AS t, (SELECT count(*) FROM w b WHERE b.w >= a.w) AS n, (SELECT count(*) FROM w b WHERE b.w <= -a.w) AS f FROM w a), l AS (SELECT max(t) AS t FROM e WHERE greatest(1, f) <= n * 0.8) SELECT feature, round(w, 4) AS w FROM w, l WHERE w.w >= l.t",
)
def threshold(spark, sf):
    """The threshold on a statistic with both signs: the brands' mean discounts about a twentieth."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    w = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature")).agg(((F.round(F.avg("l_discount"), 6) - 0.05) * 10000).alias("w"))
    return S.knockoff_select(w, 0.8).select("feature", F.round("w", 4).alias("w"))
