"""Ranks and rank correlations against plain counting."""

from __future__ import annotations

import math
import random
import statistics

import pytest

from quillon.operators import ranks as R


def plain(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_average_ranks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.randint(-3, 40)) if i % 3 else 0.0) for i in range(600)]  # a third of one value
    rows += [(900, "a", None), (901, "a", math.nan), (902, "c", None), (5, "a", -0.0)]
    got = {(r["id"], r["g"], repr(r["v"])): r["rank"] for r in R.average_ranks(spark.createDataFrame(rows, "id long, g string, v double").repartition(6), ["g"], "v", "rank").collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        own = [r for r in rows if r[1] == g and r[2] is not None and not math.isnan(r[2])]
        for (i, _, v), want in zip(own, plain([v for _, _, v in own]), strict=True):
            assert got[i, g, repr(v)] == want
    assert got[900, "a", "None"] is None and got[901, "a", "nan"] is None and got[902, "c", "None"] is None


def test_cross_edges(spark):
    rng = random.Random(8)
    x = {i: rng.random() for i in range(60)}
    left = [(i, "a", v) for i, v in x.items()] + [(i, "flat", 1.0) for i in x]
    right = [(i, "exp", math.exp(9 * v) if i % 5 else None) for i, v in x.items()] + [(i, "noise", rng.random()) for i in x] + [(i, "few", x[i]) for i in range(9)]
    l, r = (spark.createDataFrame(rows, "id long, feature string, value double") for rows in (left, right))
    got = R.cross_edges(l, r, "id", "feature", "value").collect()
    want = {}
    for name in ("exp", "noise", "few"):
        pairs = [(x[i], v) for i, n, v in right if n == name and v is not None]
        a, b = plain([p for p, _ in pairs]), plain([q for _, q in pairs])
        rho = statistics.correlation(a, b)
        if len(pairs) >= 10 and abs(rho) >= 0.3:  # of 48 rows or more, p is then under a twentieth
            want["a", name] = (round(rho, 12), len(pairs))
    assert {(e["source"], e["target"]): (round(e["r"], 12), e["n"]) for e in got} == want and want["a", "exp"] == (1.0, 48) and max(e["p"] for e in got) < 0.05
    line = R.cross_edges(l, r, "id", "feature", "value", "pearson").collect()
    assert 0.3 < {e["target"]: e["r"] for e in line}["exp"] < 0.95
    assert R.cross_edges(l.limit(0), r, "id", "feature", "value").count() == 0
    with pytest.raises(ValueError):
        R.cross_edges(l, r, "id", "feature", "value", "other")


def test_cross_edges_of_values_that_change(spark):
    """Sums of doubles may differ between two evaluations of one plan; every row keeps its rank nonetheless."""
    from pyspark.sql import functions as F

    noise = F.udf(lambda i: i + random.random() / 1e6, "double").asNondeterministic()
    rows = spark.range(40).repartition(4)
    left, right = (rows.select("id", F.lit(n).alias("feature"), noise("id").alias("value")) for n in ("a", "b"))
    assert [(e["n"], round(e["r"], 9)) for e in R.cross_edges(left, right, "id", "feature", "value").collect()] == [(40, 1.0)]
