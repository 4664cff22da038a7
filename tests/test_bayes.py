"""The Bayesian mixture: its bound, its updates against plain NumPy, planted components."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import bayes as B


def planted(seed=3):
    rng = np.random.default_rng(seed)
    turn = np.array([[1.0, 0.8], [0.0, 0.6]])
    x = np.concatenate([rng.normal(0, 1, (150, 2)) @ turn, rng.normal(0, 0.5, (100, 2)) + [8, 0], rng.normal(0, 0.7, (50, 2)) + [0, 9]])
    return x, np.repeat([0, 1, 2], [150, 100, 50])


def test_digamma():
    assert B.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721], abs=1e-12)


def test_mixture(spark):
    x, truth = planted()
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(4)
    out, model = B.bayesian_mixture(df, "id", "v", 6, rounds=60, tol=1e-5)
    got = {r["key"]: (r["cluster"], r["probability"]) for r in out.collect()}
    assert set(got) == set(range(len(x)))
    for part in range(3):  # each planted part has a component of its own
        own = [got[i][0] for i in np.flatnonzero(truth == part)]
        most = max(set(own), key=own.count)
        assert own.count(most) > 0.95 * len(own) and model["weights"][most] == pytest.approx(len(own) / len(x), abs=0.05)
    assert all(b >= a - 1e-9 for a, b in zip(model["bound"], model["bound"][1:], strict=False))  # never falls
    assert 3 <= model["effective"] < 6 and min(p for _, p in got.values()) > 0.3
    empty, nothing = B.bayesian_mixture(df.limit(0), "id", "v", 3)
    assert empty.count() == 0 and nothing["effective"] == 0


def test_one_update_is_numpy_s(spark):
    """Sums over tasks are those over all rows at once."""
    x, truth = planted()
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "key long, x array<double>").repartition(5)
    r0 = np.eye(3)[truth]
    start = B.Posterior(x.mean(0), np.cov(x.T), 0.2, r0.sum(0), r0.T @ x, np.einsum("nk,ni,nj->kij", r0, x, x))
    r, logs = B._soft(x, start)
    n, s, q, total = B._summed(df, 3, 2, lambda b, v: B._soft(v, start))
    assert n == pytest.approx(r.sum(0)) and s == pytest.approx(r.T @ x) and q == pytest.approx(np.einsum("nk,ni,nj->kij", r, x, x)) and total == pytest.approx(logs.sum())
    assert r.sum(1) == pytest.approx(np.ones(len(x))) and start.divergence() > 0
