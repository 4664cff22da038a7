"""Sparse models against their conditions of optimality, planted structure and plain counting."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import sparse as S


def frame(spark, x, names):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"id long, {', '.join(f'{n} double' for n in names)}").repartition(5)


def chain(n=4000, seed=1):
    """Rows of a Gaussian whose precision joins neighbours in a chain of five."""
    precision = np.eye(5) + np.diag([-0.45] * 4, 1) + np.diag([-0.45] * 4, -1)
    return np.random.default_rng(seed).multivariate_normal([5, 0, -3, 0, 1e4], np.linalg.inv(precision), n)


def test_moments(spark):
    x = chain(300)
    df = frame(spark, x, "abcde").unionByName(spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double, e double"))
    m = S.Moments(df, "id", list("abcde"), 4)
    n, mean, cov = m.whole()
    assert n == 300 and m.mean + mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T, ddof=0), abs=1e-7)
    (a, _, _), (b, _, _) = m.split(2)
    assert a + b == 300 and b > 40


def test_lasso_is_optimal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    y = x[:, 0] * 2 - x[:, 3] + rng.normal(size=200)
    g, c = x.T @ x / 200, x.T @ y / 200
    for alpha in (0.01, 0.3):
        w = S.lasso(g, c, alpha)
        slope = c - g @ w
        assert np.abs(slope[w != 0] - alpha * np.sign(w[w != 0])).max() < 1e-6 and np.abs(slope).max() <= alpha + 1e-6


def test_graphical_lasso_is_optimal():
    s = np.cov(chain(500).T, ddof=0)
    for alpha in (0.05, 0.2):
        t = S.graphical_lasso(s, alpha)
        gap, off = s - np.linalg.inv(t), ~np.eye(5, dtype=bool)
        on = off & (np.abs(t) > 1e-9)
        assert np.abs(np.diag(gap)).max() < 1e-5 and np.abs(gap[off]).max() <= alpha + 1e-5
        assert np.abs(gap[on] + alpha * np.sign(t[on])).max() < 1e-5


def test_partial_correlations(spark):
    x = chain()
    got = {(r["feature_1"], r["feature_2"]): r for r in S.partial_correlations(frame(spark, x, "abcde"), "id", list("abcde"), [0.01, 0.05, 0.2], threshold=0.1).collect()}
    assert len(got) == 10
    assert {p for p, r in got.items() if r["is_direct"]} == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")}
    assert got["a", "b"]["correlation"] == pytest.approx(np.corrcoef(x.T)[0, 1]) and not got["a", "c"]["is_direct"]
    assert S.partial_correlations(frame(spark, x[:0], "abcde"), "id", list("abcde")).count() == 0


def test_knockoffs_have_the_covariances(spark):
    x = chain()
    k = S.knockoffs(frame(spark, x, "abcde"), "id", list("abcde"))
    rows = np.array([[*r] for r in k.select(*(f"z_{i}" for i in range(5)), *(f"k_{i}" for i in range(5))).collect()])
    c = np.cov(rows.T)
    off = ~np.eye(5, dtype=bool)
    assert np.abs(c[5:, 5:] - c[:5, :5]).max() < 0.1 and np.abs((c[:5, 5:] - c[:5, :5])[off]).max() < 0.1
    assert np.diag(c[:5, 5:]).max() < 0.99
    again = S.knockoffs(frame(spark, x, "abcde").repartition(2), "id", list("abcde"))
    assert [r["k_3"] for r in again.orderBy("id").collect()] == pytest.approx([r["k_3"] for r in k.orderBy("id").collect()], abs=1e-6)


def test_knockoff_selection(spark):
    """Of twenty columns six matter: these come first, and few others."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 20))
    y = x[:, :6] @ np.array([1.0, -1, 1, -1, 1, -1]) + rng.normal(size=1500)
    names = [f"f{i}" for i in range(20)]
    w = S.knockoff_statistics(frame(spark, np.column_stack([x, y]), [*names, "y"]), "id", names, "y")
    best = {r["feature"] for r in w.orderBy("w", ascending=False).limit(6).collect()}
    assert best == set(names[:6])
    got = {r["feature"] for r in S.knockoff_select(w, 0.2).collect()}
    assert got <= best and len(got) == 5  # one in five: the first threshold that passes


@pytest.mark.parametrize("fdr", [0.1, 0.35, 0.6])
def test_threshold(spark, fdr):
    w = np.array([5, 4, 4, 3, -3, 2, 2, -1, 1, 0, -4, 0.5])
    want = set()
    for t in sorted(w, reverse=True):
        if max(1, (w <= -t).sum()) / (w >= t).sum() <= fdr:
            want = {f"f{i}" for i in np.flatnonzero(w >= t)}
            break
    df = spark.createDataFrame([(f"f{i}", float(v)) for i, v in enumerate(w)], "feature string, w double")
    assert {r["feature"] for r in S.knockoff_select(df, fdr).collect()} == want
