"""Imputation on planted relations: error under the mean's, seeds, spread between draws, awkward tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillon.operators import impute as I


def planted(n=600, seed=4):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    x = np.column_stack([a, b, np.sin(2 * a) * 3 + b + rng.normal(size=n) * 0.1, (a > 0) * 2.0 + 1])
    gone = rng.random((n, 4)) < np.array([0.0, 0.0, 0.25, 0.2])
    return x, gone


def frame(spark, x, gone, names="abcd"):
    rows = [(i, *(None if g else float(v) for v, g in zip(r, h, strict=True))) for i, (r, h) in enumerate(zip(x, gone, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(4)


def values(df, names="abcd"):
    return np.array([[r[c] for c in names] for r in df.orderBy("id").collect()], float)


def test_forest(spark):
    x, gone = planted()
    got = values(I.impute_forest(frame(spark, x, gone), "id", list("abcd"), rounds=3, trees=15))
    assert (got[~gone] == x[~gone]).all()
    c = gone[:, 2]
    plain = np.abs(x[~c, 2].mean() - x[c, 2])
    assert np.abs(got[c, 2] - x[c, 2]).mean() < 0.3 * plain.mean()
    d = gone[:, 3]
    assert set(got[:, 3]) == {1.0, 3.0} and (got[d, 3] == x[d, 3]).mean() > 0.9  # two values: classes, not means


def test_forest_on_odd_tables(spark):
    none = spark.createDataFrame([], "id long, a double, b double")
    assert I.impute_forest(none, "id", ["a", "b"]).count() == 0
    one = spark.createDataFrame([(1, 2.0, None), (2, math.nan, None), (3, 2.0, None)], "id long, a double, b double")
    assert [(r["a"], r["b"]) for r in I.impute_forest(one, "id", ["a", "b"]).orderBy("id").collect()] == [(2.0, None)] * 3


def linear(n=3000, seed=8):
    """c is missing more often where a is large, so that its observed mean is too low."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(5, 1, n), rng.normal(0, 2, n)
    x = np.column_stack([a, b, 2 * a - b + rng.normal(size=n)])
    gone = np.zeros((n, 3), bool)
    gone[:, 2] = rng.random(n) < 1 / (1 + np.exp(-2 * (a - 5)))
    gone[:, 1] = rng.random(n) < 0.1
    return x, gone


def test_draws(spark):
    x, gone = linear()
    df = frame(spark, x, gone, "abc")
    drawn = I.impute_draws(df, "id", list("abc"), draws=6, rounds=3)
    rows = drawn.orderBy("draw", "id").collect()
    assert len(rows) == 6 * len(x)
    got = np.array([[r[c] for c in "abc"] for r in rows]).reshape(6, -1, 3)
    assert (np.abs(got - x)[:, ~gone] < 1e-9).all()
    pooled = {r["feature"]: r for r in I.pooled_means(drawn, list("abc")).collect()}
    truth, seen = x[:, 2].mean(), x[~gone[:, 2], 2].mean()
    assert abs(pooled["c"]["estimate"] - truth) < 0.15 < truth - seen
    assert pooled["a"]["between"] == pytest.approx(0, abs=1e-18) and pooled["c"]["between"] > 0 and 0 < pooled["c"]["fraction"] < 1
    means = got[:, :, 2].mean(1)
    within = np.mean([got[m, :, 2].var(ddof=1) / len(x) for m in range(6)])
    assert pooled["c"]["variance"] == pytest.approx(within + (1 + 1 / 6) * means.var(ddof=1))
    rest = got[:, gone[:, 2], 2] - (2 * x[gone[:, 2], 0] - x[gone[:, 2], 1])
    assert 0.9 < rest[:, ~gone[gone[:, 2], 1]].std() < 1.15  # the residual's spread, not a regression line
    again = I.impute_draws(df.repartition(3), "id", list("abc"), draws=6, rounds=3).orderBy("draw", "id").collect()
    assert np.array([[r[c] for c in "abc"] for r in again]) == pytest.approx(got.reshape(-1, 3), abs=1e-6)
    other = I.impute_draws(df, "id", list("abc"), draws=1, rounds=1, seed=1).orderBy("id").collect()
    assert any(abs(r["c"] - v) > 1e-3 for r, v in zip(other, got[0, :, 2], strict=True))


def test_draws_shifted_and_odd_tables(spark):
    x, gone = linear(200)
    df = frame(spark, x, gone, "abc")
    base, moved = (values(I.impute_draws(df, "id", list("abc"), 1, 2, d, ["c"]), "abc") for d in (0.0, 4.0))
    assert (moved - base)[gone[:, 2], 2] == pytest.approx(4.0) and (moved - base)[~gone[:, 2], 2] == pytest.approx(0) and (moved - base)[:, :2] == pytest.approx(0)
    assert I.impute_draws(df.limit(0), "id", list("abc"), 2).count() == 0
    odd = spark.createDataFrame([("x", 1.0, None), ("y", None, None), ("y", None, None)], "id string, a double, b double")
    got = [(r["id"], r["draw"], r["a"], r["b"]) for r in I.impute_draws(odd, "id", ["a", "b"], 2, 1).orderBy("id", "draw").collect()]
    assert [(k, m, b) for k, m, _, b in got] == [("x", 0, None), ("x", 1, None)] + [("y", 0, None)] * 2 + [("y", 1, None)] * 2
    assert got[0][2] == 1.0 and got[2] == got[3] and all(a is not None for _, _, a, _ in got)
