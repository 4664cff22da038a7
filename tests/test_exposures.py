"""Series, mixtures, specificity and synthetic cohorts on hand-computed cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import mixtures as X
from quillon.operators import windows as W
from quillon.sources import synthetic


def test_average_ranks_of_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("a", None)], "f string, v double")
    got = {r["v"]: r["q"] for r in X.average_ranks(df, "f", "v").collect()}
    assert got == pytest.approx({1.0: 1 / 5, 2.0: 2.5 / 5, 9.0: 4 / 5})


def test_mixture_of_one_cause(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(3 * a)) for a, b in zip(x, z, strict=True)] + [(None, 1.0, 1.0)], "x double, z double, y double")
    got = {r["feature"]: r for r in X.quantile_mixture(df, ["x", "z"], "y", [F.lit(True), F.col("z") > 0]).collect()}
    rank = lambda v: (np.argsort(np.argsort(v)) + 1) / 401
    part = z > 0
    share = lambda m: np.array([abs(np.corrcoef(rank(v)[m], 3 * x[m])[0, 1]) for v in (x, z)])
    w = np.mean([share(m) / share(m).sum() for m in (np.ones(400, bool), part)], axis=0)
    assert [got["x"]["weight"], got["z"]["weight"]] == pytest.approx(w)
    assert got["x"]["effect"] == pytest.approx(np.polyfit(rank(x) * w[0] + rank(z) * w[1], 3 * x, 1)[0])


def test_critical_periods(spark):
    df = spark.createDataFrame([("p", float(i), 2.0 * i + (i % 2)) for i in range(10)] + [("q", float(i), 0.1 * i - (i % 2)) for i in range(10)], "period string, x double, y double")
    got = {r["period"]: r for r in X.critical_periods(df, "period", "x", "y").collect()}
    assert got["p"]["strongest"] and not got["q"]["strongest"]
    assert got["p"]["effect"] == pytest.approx(np.polyfit(range(10), [2.0 * i + (i % 2) for i in range(10)], 1)[0])


def test_specificity(spark):
    df = spark.createDataFrame([("g", "in", 3.0), ("g", "in", -3.0), ("g", "out", 1.0), ("h", "in", 0.0), ("h", "out", 0.0), ("i", "in", 1.0)], "g string, r string, e double")
    assert {r[0]: r[1] for r in X.specificity(df, ["g"], "e", F.col("r") == "in").collect()} == {"g": 0.75, "h": 0.0, "i": None}


def test_energy_peaks(spark):
    beat = [0.0] * 20
    for at in (4, 14):
        beat[at] = 10.0
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(beat)], "k string, t int, v double")
    got = sorted(r["gap"] or 0 for r in W.energy_peaks(df, ["k"], ["t"], "v", 3).collect())
    assert got == [0, 10]
    one = spark.createDataFrame([("u", 1, 1.0)], "k string, t int, v double")
    assert W.energy_peaks(one, ["k"], ["t"], "v", 3).count() == 0 == W.transition_rate(one, ["k"], ["t"], "v").count()


def test_cohort(spark):
    ids = spark.range(20000)
    c = synthetic.cohort(ids, "id", features=3)
    a, b = c.orderBy("id").limit(50).collect(), synthetic.cohort(ids.repartition(7), "id", features=3).orderBy("id").limit(50).collect()
    assert a == b
    m = {r["subtype"]: r for r in c.groupBy("subtype").agg(F.avg("f0").alias("m"), F.stddev_samp("f0").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    assert m[0]["m"] == pytest.approx(2, abs=0.1) and m[1]["m"] == pytest.approx(0, abs=0.1)
    assert m[1]["s"] == pytest.approx(1, abs=0.05) and min(r["n"] for r in m.values()) > 6000


def test_bray_curtis_exchanges_no_pairs(spark, monkeypatch):
    """All pairs that share a kind, of queries and rows in several blocks; the plan exchanges rows only."""
    import random

    from pyspark.sql import functions as F

    from quillon.operators import cluster as K

    monkeypatch.setattr(K, "QUERY_BLOCK", 3)
    monkeypatch.setattr(K, "ROW_BLOCK", 7)
    rng = random.Random(2)
    n = {(u, t): rng.randint(1, 9) for u in range(40) for t in "abcd" if rng.random() < 0.4} | {(3, None): 5, (None, "a"): 2}
    got = K.bray_curtis(spark.createDataFrame([(u, t, v) for (u, t), v in n.items()], "u long, t string, n long"), F.col("u") % 4 == 0)
    total = {u: sum(v for (w, _), v in n.items() if w == u) for u, _ in n}
    want = {}
    for x in (u for u in total if u is not None and u % 4 == 0):
        for y in total:
            m = sum(min(n.get((x, t), 0), n.get((y, t), 0)) for t in "abcd") if y is not None and y != x else 0
            if m:
                want[x, y] = 1 - 2 * m / (total[x] + total[y])
    assert {(r["x"], r["y"]): r["distance"] for r in got.collect()} == want
    few = K.bray_curtis(spark.createDataFrame([(u, "a", 1) for u in range(40)], "u long, t string, n long"), F.col("u") == 3)  # blocks without rows
    assert few.count() == 39
    assert "HashAggregate(keys=[x" not in got._jdf.queryExecution().toString()
