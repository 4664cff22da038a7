"""The factor model: planted factors, missing modalities, a bound that never falls."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import factors as M


def planted(n=400, seed=5):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 2))
    w = np.zeros((9, 2))
    w[:5, 0], w[5:, 1] = rng.uniform(1, 2, 5), rng.uniform(1, 2, 4)
    w[4, 1] = 1.5  # one column of the first modality shares the second factor
    y = z @ w.T + rng.normal(0, 0.3, (n, 9)) + np.arange(9)
    return z, y


def frame(spark, y, lost=()):
    rows = [(i, None if i in lost else [float(v) for v in r[:5]], [None if (i, 1) == (j, k) else float(v) for k, v in enumerate(r[5:]) for j in (7,)]) for i, r in enumerate(y)]
    return spark.createDataFrame(rows, "id long, a array<double>, b array<double>").repartition(4)


def test_planted_factors(spark):
    z, y = planted()
    lost = set(range(0, 400, 10))
    out, model = M.factor_model(frame(spark, y, lost), "id", {"a": 5, "b": 4}, 4, rounds=60, tol=1e-6)
    got = np.array([r["factors"] for r in out.orderBy("key").collect()])
    assert len(got) == 400
    steps = np.diff(model["bound"])
    assert steps.min() > -1e-9 and len(steps) > 5
    whole = np.array([i for i in range(400) if i not in lost])
    fit, *_ = np.linalg.lstsq(got[whole], z[whole], rcond=None)  # up to a turn of the factors
    for j in range(2):
        assert np.corrcoef((got[whole] @ fit)[:, j], z[whole, j])[0, 1] > 0.97
    strength = np.sqrt((np.array(model["loadings"]["a"]) ** 2).sum(0) + (np.array(model["loadings"]["b"]) ** 2).sum(0))
    assert strength.min() < 0.01 < 1 < strength.max() and max(model["alpha"]) > 10 * min(model["alpha"])  # what isn't needed goes
    assert model["noise"] == pytest.approx([0.09] * 9, abs=0.05) and model["means"] == pytest.approx(list(range(9)), abs=0.5)
    assert sum(model["explained"]["a"]) > 0.8


def test_likelihood_is_numpy_s():
    """A row's likelihood is that of a Gaussian of the columns seen."""
    rng = np.random.default_rng(1)
    model = M.Factors(rng.normal(size=(4, 2)), rng.uniform(1, 3, 4), np.ones(2))
    y, seen = rng.normal(size=(3, 4)), np.array([[1, 1, 1, 1], [1, 0, 1, 0], [0, 0, 0, 0]], bool)
    mean, _, logs = model.posterior(np.where(seen, y, 0.0), seen)
    cov = model.w @ model.w.T + np.diag(1 / model.tau)
    for i in range(3):
        o = np.flatnonzero(seen[i])
        c = cov[np.ix_(o, o)]
        assert logs[i] == pytest.approx(-0.5 * (len(o) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + y[i, o] @ np.linalg.solve(c, y[i, o])) if len(o) else 0.0)
        assert mean[i] == pytest.approx(model.w[o].T @ np.linalg.solve(c, y[i, o]) if len(o) else np.zeros(2))


def test_nothing(spark):
    _, y = planted(3)
    out, model = M.factor_model(frame(spark, y).limit(0), "id", {"a": 5, "b": 4}, 2, rounds=3)
    assert out.count() == 0 and len(model["loadings"]["b"]) == 4
