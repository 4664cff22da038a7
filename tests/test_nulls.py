"""Null distributions against plain permutations in NumPy, planted clusters and one Gaussian."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import nulls as N


def frame(spark, x, labels):
    return spark.createDataFrame([(i, [*map(float, v)], int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "id long, x array<double>, label int").repartition(5)


def blobs(n=300, apart=6.0, seed=3):
    rng = np.random.default_rng(seed)
    labels = np.array([0] * (n // 2) + [1] * (n // 3) + [2] * (n - n // 2 - n // 3))
    return rng.normal(size=(n, 2)) + apart * np.array([[0, 0], [1, 0], [0, 1]])[labels], labels


def test_cuts_deal_exact_sizes(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    rows = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3)
    sizes = np.array([1, 0, 1999, 2500, 500])
    ends = N.cuts(rows, sizes, 3)
    for m in range(3):
        h = N.mixed(keys, m)
        assert len(set(h)) == len(keys)
        assert np.bincount(np.searchsorted(ends[m, [0, 2, 3]], h, side="left"), minlength=4).tolist() == [1, 1999, 2500, 500]


def test_cuts_of_one_key(spark):
    rows = spark.createDataFrame([(7,)] * 10 + [(8,)] * 2, "key long")
    assert N.cuts(rows, np.array([6, 6]), 2).shape == (2, 1)


def test_permutations(spark):
    x, labels = blobs(120, apart=0.45)
    got = N.permutation_test(frame(spark, x, labels), "id", "x", "label", draws=200).first()
    tight = lambda l: -np.log(sum(((x[l == k] - x[l == k].mean(0)) ** 2).sum() for k in range(3)))
    assert got["observed"] == pytest.approx(tight(labels))
    rng = np.random.default_rng(0)
    null = np.array([tight(rng.permutation(labels)) for _ in range(2000)])
    assert got["null_mean"] == pytest.approx(null.mean(), abs=4 * null.std() / np.sqrt(200)) and got["null_std"] == pytest.approx(null.std(), rel=0.3)
    assert abs(got["p"] - (null >= tight(labels)).mean()) < 0.1 and got["groups"] == 3


def test_permutation_of_a_users_statistic(spark):
    x, labels = blobs(90)
    gap = lambda n, s, q: s[0, 0] / n[0] - s[1, 0] / n[1]
    got = N.permutation_test(frame(spark, x, np.minimum(labels, 1)), "id", "x", "label", gap, 50, two_sided=True).first()
    assert got["observed"] == pytest.approx(x[labels == 0, 0].mean() - x[labels > 0, 0].mean()) and got["p"] == 0.0
    flat = frame(spark, np.ones((20, 1)), [0, 1] * 10)  # ties: every permutation is as good
    assert N.permutation_test(flat, "id", "x", "label", gap, 20, two_sided=True).first()["p"] == 1.0
    assert N.permutation_test(flat.filter("label = 0"), "id", "x", "label").count() == 0
    assert N.permutation_test(flat.limit(0), "id", "x", "label").count() == 0


def test_gap_and_sigclust(spark):
    x, labels = blobs(300)
    df = frame(spark, x, labels)
    got = N.gap_statistic(df, "id", "x", "label", 3).first()
    assert got["within"] == pytest.approx(sum(((x[labels == k] - x[labels == k].mean(0)) ** 2).sum() for k in range(3))) and got["gap"] > 0.3
    assert N.sigclust(df, "id", "x", "label", 4).first()["p"] == 0.0
    y = np.random.default_rng(5).normal(size=(300, 2))
    one = frame(spark, y, (y[:, 0] > 0).astype(int) + 2 * (y[:, 1] > 1.5))
    assert N.sigclust(one, "id", "x", "label", 4).first()["p"] > 0.5
    assert N.gap_statistic(df.limit(0), "id", "x", "label").count() == 0 and N.sigclust(df.filter("label = 1"), "id", "x", "label").count() == 0
