"""Stability selection on planted columns, and one draw against the same rows in NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import stability as S
from quillon.operators.sparse import lasso


def test_planted_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 1, size=(800, 10))
    y = 2 * x[:, 1] - 1.5 * x[:, 4] + x[:, 7] + rng.normal(size=800)
    names = [f"f{i}" for i in range(10)]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], f"id long, {', '.join(f'{n} double' for n in names)}, y double").repartition(4)
    got = {r["feature"]: r for r in S.stability_selection(df, "id", names, "y", 12, threshold=0.95, alphas=8).collect()}
    assert all(got[f"f{i}"]["probability"] == 1.0 and got[f"f{i}"]["selected"] for i in (1, 4, 7))
    assert np.mean([got[f"f{i}"]["probability"] for i in (0, 2, 3, 5, 6, 8, 9)]) < 0.8
    again = {r["feature"]: r["probability"] for r in S.stability_selection(df.repartition(2), "id", names, "y", 12, alphas=8).collect()}
    assert again == {n: r["probability"] for n, r in got.items()}
    odd = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 1.0)], "id long, a double, y double")
    assert [(r["feature"], r["probability"], r["selected"]) for r in S.stability_selection(odd, "id", ["a"], "y", 2).collect()] == [("a", 0.0, False)]


def test_fit_by_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 5))
    y = x[:, 0] + rng.normal(size=150) * 0.5
    z, fold = np.column_stack([x, y]), rng.integers(0, 3, 150)
    folds = np.stack([np.concatenate([[len(o)], o.sum(0), (o.T @ o).ravel()]) for o in (z[fold == f] for f in range(3))])
    fit = lambda a, b, alpha: (lasso((u := a - a.mean(0)).T @ u / len(a), u.T @ (b - b.mean()) / len(a), alpha), a.mean(0), b.mean())
    most = np.abs((x - x.mean(0)).T @ (y - y.mean()) / 150).max()
    grid, error = np.logspace(np.log10(most) - 3, np.log10(most), 6), []
    for alpha in grid:
        total = 0.0
        for f in range(3):
            w, a, b = fit(x[fold != f], y[fold != f], alpha)
            total += ((y[fold == f] - b - (x[fold == f] - a) @ w) ** 2).sum()
        error.append(total)
    assert S._fitted(folds, 6, 6) == pytest.approx(fit(x, y, grid[int(np.argmin(error))])[0], abs=1e-5)
