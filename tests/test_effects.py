"""The forest on a planted effect, against plain sums, and on awkward tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillon.operators import effects as E
from quillon.operators.nulls import mixed


def planted(n=6000, seed=2):
    """The treatment adds 4 where a > 0.5, and nothing elsewhere; b moves the outcome alone, c nothing."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    w = (rng.random(n) < 0.4).astype(float)
    return x, w, 3 * x[:, 1] + 4 * (x[:, 0] > 0.5) * w + rng.normal(size=n)


def frame(spark, x, w, y):
    return spark.createDataFrame([(i, *map(float, (*r, t, v))) for i, (r, t, v) in enumerate(zip(x, w, y, strict=True))], "id long, a double, b double, c double, w double, y double").repartition(5)


def test_planted_effect(spark):
    x, w, y = planted()
    df = frame(spark, x, w, y)
    forest = E.CausalForest(df, "id", list("abc"), "w", "y", trees=20, depth=3)
    got = forest.scored(df)
    rows = np.array([(r["a"], r["effect"]) for r in got.collect()])
    high = rows[:, 0] > 0.5
    assert abs(rows[high, 1].mean() - 4) < 0.35 and abs(rows[~high, 1].mean()) < 0.35
    first = forest.feature[:, 1]
    assert (first == 0).mean() > 0.55  # a is drawn in two of three trees
    groups = {r["group"]: r for r in E.quantile_groups(got, "effect", "w", "y").collect()}
    assert sorted(groups) == [0, 1, 2, 3] and groups[0]["low"] < 0 < groups[0]["high"] and groups[3]["low"] < 4 < groups[3]["high"] and groups[3]["low"] > 2
    # A leaf's effect is that of the second part's rows.
    keys, order = np.array([[*r] for r in df.selectExpr("xxhash64(id, 42)", "id").collect()]).T
    x, w, y = x[order], w[order].astype(int), y[order]
    at, own = forest._leaf(3, forest._binned(x), 3), mixed(np.ascontiguousarray(keys), 3) % np.uint64(3) == 1
    for leaf in np.unique(at):
        in_ = own & (at == leaf)
        assert forest.effect[3, leaf] == pytest.approx(y[in_ & (w == 1)].mean() - y[in_ & (w == 0)].mean())
    again = E.CausalForest(df.repartition(2), "id", list("abc"), "w", "y", trees=20, depth=3)
    assert (again.feature == forest.feature).all() and again.effect == pytest.approx(forest.effect, nan_ok=True)


def test_split_by_trying_all():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, w, y = rng.integers(0, 6, (200, 3)), rng.integers(0, 2, 200), rng.normal(size=200)
        table = np.zeros((3, 6, 2, 2))
        for j in range(3):
            np.add.at(table[j], (x[:, j], w), np.stack([np.ones(200), y], 1))
        best = (-1.0, None)
        for j in (0, 2):
            for k in range(6):
                sides = [x[:, j] <= k, x[:, j] > k]
                if min((s & (w == t)).sum() for s in sides for t in (0, 1)) >= 5:
                    a, b = (y[s & (w == 1)].mean() - y[s & (w == 0)].mean() for s in sides)
                    gain = sides[0].sum() * sides[1].sum() / 200**2 * (a - b) ** 2
                    best = max(best, (gain, (j, k)), key=lambda t: t[0])
        assert E._best_split(table, np.array([2, 0]), 5) == best[1]


def test_odd_tables(spark):
    schema = "id long, a double, w double, y double"
    df = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (1, 1.0, 1.0, 2.0), (2, None, 0.0, 1.0), (3, math.nan, 0.0, 1.0), (4, 1.0, None, 1.0), (5, 1.0, 1.0, None)], schema)
    got = E.CausalForest(df, "id", ["a"], "w", "y", trees=3, depth=2).scored(df)
    assert got.count() == 6 and got.filter("effect is not null").count() == 0  # one arm alone
    assert E.CausalForest(df.limit(0), "id", ["a"], "w", "y", trees=2).scored(df.limit(0)).count() == 0
    assert E.quantile_groups(got, "effect", "w", "y").count() == 0
    assert [(r["group"], r["n"], r["treated"], r["effect"]) for r in E.grouped_effects(df.filter("id < 3"), "a", "w", "y").orderBy("group").collect()] == [(None, 1, 0, None), (1.0, 2, 2, None)]
