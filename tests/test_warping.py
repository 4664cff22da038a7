"""Time warping against the plain recurrence, its bound, and planted shapes."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillon.operators import warping as W


def plain(a, b, band):
    """Squared cost and path by the recurrence, a cell at a time."""
    cost = {(0, 0): (0.0, ())}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j) <= band:
                best = min((cost[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in cost), key=lambda c: c[0])
                cost[i, j] = (best[0] + float(((a[i - 1] - b[j - 1]) ** 2).sum()), (*best[1], (i - 1, j - 1)))
    return cost[len(a), len(b)]


@pytest.mark.parametrize("band", [0, 2, 8])
def test_distances_bounds_and_paths(band):
    rng = np.random.default_rng(1)
    x, centres = rng.normal(size=(30, 8, 2)).cumsum(1), rng.normal(size=(4, 8, 2)).cumsum(1)
    want = np.array([[plain(s, c, band)[0] for c in centres] for s in x])
    for c in range(4):
        assert W.costs(x, centres[c], band)[:, -1, -1] == pytest.approx(want[:, c])
        assert (W.lower_bounds(x, centres[c], band) <= want[:, c] + 1e-9).all()
    at, cost, warped = W.nearest(x, centres, band)
    assert (at == want.argmin(1)).all() and cost == pytest.approx(want.min(1)) and 30 <= warped <= 120
    if band == 0:
        assert warped == 30  # the bound is the distance itself
    sums, counts = np.zeros((8, 2)), np.zeros(8)
    for s in x:
        for i, j in plain(s, centres[0], band)[1]:
            sums[j] += s[i]
            counts[j] += 1
    got = W.path_sums(x, centres[0], band)
    assert got[0] == pytest.approx(sums) and (got[1] == counts).all()


def shapes(n=90, seed=4):
    """Three shapes, shifted in time by up to two steps and scaled."""
    rng, t = np.random.default_rng(seed), np.arange(16)
    kinds = np.arange(n) % 3
    make = [lambda s: np.exp(-((t - 5 - s) ** 2) / 3.0), lambda s: (t > 8 + s) * 1.0, lambda s: np.cos((t - s) * np.pi / 4)]
    return np.array([make[k](rng.integers(-1, 2)) * rng.uniform(2, 5) + rng.normal(size=16) * 0.05 + 7 for k in kinds]), kinds


def test_planted_shapes(spark):
    x, kinds = shapes()
    df = spark.createDataFrame([(f"s{i}", [*map(float, s)]) for i, s in enumerate(x)], "id string, x array<double>").repartition(4)
    odd = spark.createDataFrame([("short", [1.0]), ("null", None), ("nan", [math.nan] * 16), ("gap", [None] + [1.0] * 15)], "id string, x array<double>")
    model = W.TrajectoryClusters(df.unionByName(odd), "id", "x", 16, k=3, band=4, rounds=4)
    got = {r["id"]: r for r in model.assigned().collect()}
    assert len(got) == 90
    labels = np.array([got[f"s{i}"]["cluster"] for i in range(90)])
    assert len({(a, b) for a, b in zip(labels, kinds, strict=True)}) == 3 and len(set(labels)) == 3
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    for i in range(0, 90, 13):
        assert got[f"s{i}"]["distance"] == pytest.approx(min(plain(z[i][:, None], c, 4)[0] for c in model.centres) ** 0.5)
    assert 0.3 < model.pruned() < 0.7  # of three centres two at most are spared
    again = W.TrajectoryClusters(df.repartition(2), "id", "x", 16, k=3, band=4, rounds=4)
    assert again.centres == pytest.approx(model.centres)


def test_few_series(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3 + [(2, [5.0, 5.0, 5.0])], "id long, x array<double>")
    model = W.TrajectoryClusters(same, "id", "x", 3, k=4, rounds=2)
    assert len(model.centres) == 2 and sorted((r["id"], round(r["distance"], 9)) for r in model.assigned().collect()) == [(1, 0.0)] * 3 + [(2, 0.0)]
    none = W.TrajectoryClusters(same.limit(0), "id", "x", 3, k=2)
    assert none.assigned().count() == 0 and none.pruned() == 0.0
