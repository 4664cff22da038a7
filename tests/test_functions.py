"""Known answers and invariants of functions that SQL doesn't express."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import special


def test_known_tails():
    assert special.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert special.t_tail(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.hypergeometric_tail(3, 1, 1, 3) == pytest.approx(17 / 70)


@given(st.floats(0.001, 0.999))
@settings(max_examples=50)
def test_normal_quantile_inverts(p):
    z = special.normal_quantile(p)
    assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, abs=1e-10)


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_ratio_is_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    want = 1.0 if not a and not b else 2 * t[-1][-1] / (len(a) + len(b))
    assert special.lcs_ratio(a, b) == pytest.approx(want)


def test_combat_centres_batches(spark):
    from pyspark.sql import functions as F

    from quillon.operators.stats import combat

    rows = [(f"s{i}", f"f{j}", "a" if i < 20 else "b", (i * 7919 + j * 104729) % 1000 / 100 + (5.0 if i >= 20 else 0.0)) for i in range(40) for j in range(6)]
    df = spark.createDataFrame(rows, "s string, f string, batch string, v double")
    gap = lambda c: abs(df_out.groupBy("batch").agg(F.avg(c).alias("m")).agg((F.max("m") - F.min("m")).alias("g")).first()["g"])
    df_out = combat(df, "f", "batch", "v")
    assert gap("v") > 4 and gap("adjusted") < 0.5


def test_stages_resume(spark, tmp_path):
    from quillon.sources.sinks import Stages

    stages, calls = Stages(spark, str(tmp_path)), []

    def make():
        calls.append(1)
        return spark.range(5)

    assert stages.run("one", make).count() == stages.run("one", make).count() == 5
    assert len(calls) == 1


def test_radius_near_poles_and_date_line(spark):
    from quillon.operators import joins

    def miles(a, b):
        x, y = math.radians(a[1]), math.radians(b[1])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 3959 * math.asin(math.sqrt(min(h, 1.0)))

    rng = random.Random(3)
    for radius in (25.0, 150.0):
        points = [(i, lat + rng.uniform(-1, 1), lon + rng.uniform(-4, 4)) for i, (lat, lon) in enumerate([(0, 179), (75, -177), (-88.9, 40), (34, -95), (0, -179)] * 40)]
        points += [(900, 90.0, 10.0), (901, 89.9, -170.0), (902, 10.0, 180.0), (903, 10.1, -180.0), (904, -90.0, 0.0)]
        want = {(a[0], b[0]) for a in points for b in points if miles(a, b) <= radius}
        df = spark.createDataFrame(points, "a long, lat double, lon double")
        got = [(r["a"], r["b"]) for r in joins.radius_join(df, df.withColumnRenamed("a", "b"), "lat", "lon", radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_closure_names_its_limit(spark):
    from quillon.operators import graph

    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "c long, p long")
    assert graph.closure(chain, "c", "p", most=5).count() == 15
    with pytest.raises(ValueError, match="levels"):
        graph.closure(chain, "c", "p", most=3)
