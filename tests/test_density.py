"""Density clusters, consensus and topology on point clouds with known answers; imputation and causal estimates against NumPy."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import density, graph, manifold, neighbours
from quillon.operators import stats as M
from quillon.operators import windows as W
from tests import plain_density as plain


def blobs(n=60, noise=0, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c in ((0, 0), (6, 0), (0, 6))] + [rng.uniform(-20, 20, (noise, 2))])
    return x, np.concatenate([np.repeat(np.arange(3), n), np.full(noise, -1)])


def agree(a, b):
    """Pairs on which two labellings agree."""
    return np.mean([(a[i] == a[j]) == (b[i] == b[j]) for i, j in itertools.combinations(range(0, len(a), 3), 2)])


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


def forest(edges):
    """Kruskal's edges, ties by both ends."""
    up, out = {}, {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for w, a, b in sorted(edges):
        if find(a) != find(b):
            up[find(a)] = find(b)
            out[a, b] = w
    return out


def test_components(spark):
    r = random.Random(4)
    edges = [(g, r.randrange(60), r.randrange(60)) for g in (0, 1) for _ in range(35)] + [(2, i, i + 1) for i in range(100)] + [(3, 5, 5)]
    df = spark.createDataFrame(edges, "g long, a long, b long")
    got = {(x["g"], x["node"]): x["component"] for x in graph.components(df, ("g",)).collect()}
    for g in (0, 1, 2, 3):
        up = forest([(1, a, b) for h, a, b in edges if h == g and a != b])
        near = collections.defaultdict(set)
        for a, b in up:
            near[a].add(b)
            near[b].add(a)
        for node in near:
            seen, todo = {node}, [node]
            while todo:
                more = near[todo.pop()] - seen
                seen |= more
                todo += more
            assert got.pop((g, node)) == min(seen)
    assert not got


def test_spanning_forest(spark):
    r = random.Random(2)
    edges = {(a, b): r.randrange(6) for a, b in itertools.combinations(range(40), 2) if r.random() < 0.1}
    df = spark.createDataFrame([(b, a, float(w)) for (a, b), w in edges.items()] + [(3, 3, 0.0), (1, None, 1.0)], "a long, b long, w double")
    assert {(x["a"], x["b"]): x["w"] for x in graph.spanning_forest(df).collect()} == forest([(w, a, b) for (a, b), w in edges.items()])
    assert graph.spanning_forest(df.limit(0)).count() == 0


def test_nearest_with_a_hot_cell(spark, monkeypatch):
    """A third of all rows at one place, rows without a vector, more neighbours than blocks hold."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((50, 3)), rng.normal(0, 1, (60, 3)), rng.normal(9, 1, (40, 3))])
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, None), (None, [1.0, 2.0, 3.0])], "id long, v array<double>"))
    near, far = plain.neighbour_distances(x, 7)
    cells = neighbours.Cells(df, "id", "v", 7, pivots=6)
    assert len(cells.near()) < 36  # far cells aren't met
    got = {(r["key"], r["rank"]): (r["neighbour"], r["distance"]) for r in neighbours.nearest(cells, 7).collect()}
    assert got == {(i, j + 1): (near[i, j], far[i, j]) for i in range(len(x)) for j in range(7)}


@pytest.mark.parametrize("k, core", [(3, 0), (4, 3)])
def test_minimum_spanning_tree(spark, k, core):
    """Lists of few neighbours leave gaps that the search closes: the tree is that of all pairs."""
    x = np.concatenate([blobs(25, 6)[0], [[0.0, 0.0]] * 4, [[50.0, 50.0]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if core:
        c = plain.neighbour_distances(x, core)[1][:, -1]
        d = np.maximum(d, np.maximum(c[:, None], c[None]))
    want = forest([(d[a, b], a, b) for a, b in itertools.combinations(range(len(x)), 2)])
    got = {(r["a"], r["b"]): r["w"] for r in density.Cloud(frame(spark, x), "id", "v", k, pivots=5).tree(core).collect()}
    assert got == want


def test_density_clusters(spark):
    x, truth = blobs(30, 8)
    cloud = density.Cloud(frame(spark, x), "id", "v", 6)
    tree = cloud.tree(4)
    cuts = sorted({r["w"] for r in tree.collect()})  # a cut at every edge: the whole hierarchy
    member = density.memberships(tree, cuts)
    for least in (5, 12):
        found = density.chains(member, cuts, least)
        got = {r["key"]: r["cluster"] for r in density.labelled(cloud, member, density.chosen(found)).collect()}
        want = plain.density_clusters(x, least, 4)
        names = {c: int(np.flatnonzero(want == c)[0]) for c in range(want.max() + 1)}
        assert [got[i] for i in range(len(x))] == [names.get(c, -1) for c in want]
    leaves = density.labelled(cloud, member, density.chosen(found, "leaf"))
    assert leaves.filter("cluster >= 0").select("cluster").distinct().count() >= len(names)
    inside = truth >= 0
    assert agree(np.array([got[i] for i in np.flatnonzero(inside)]), truth[inside]) > 0.97
    assert {r["cluster"] for r in density.density_clusters(frame(spark, x[:5]), "id", "v", 10, 4, 6).collect()} == {-1}


def test_consensus(spark):
    x, truth = blobs(25)
    cloud = density.Cloud(frame(spark, x), "id", "v", 6)
    runs = density.sweep(cloud, least=(8, 12), neighbours=(4,), methods=("eom",))
    assert runs.count() == 2 * len(x)
    got = {r["key"]: (r["cluster"], r["confidence"]) for r in density.consensus(cloud, runs, least=5).collect()}
    labels = np.array([got[i][0] for i in range(len(x))])
    assert len(set(labels[labels >= 0])) == 3 and agree(labels, truth) > 0.95
    assert np.mean([c for k, c in got.values() if k >= 0]) > 0.9
    nothing = runs.withColumn("cluster", F.lit(-1))
    assert {(r["cluster"], r["confidence"]) for r in density.consensus(cloud, nothing).collect()} == {(-1, 0.0)}


def test_tree_measures(spark):
    rng = np.random.default_rng(6)
    w = np.round(rng.exponential(1, 90), 1)
    labels = rng.integers(0, 2, 91)
    tree = spark.createDataFrame([(i, i + 1, float(v)) for i, v in enumerate(w)], "a long, b long, w double")
    got = density.tree_gaps(tree).first()
    s, gap = np.sort(w), np.diff(np.sort(w))
    p = w[w > 0] / w.sum()
    want = {"mean_within": s[:45].mean(), "mean_between": s[45:].mean(), "max_gap": gap.max(), "gap_threshold": np.percentile(gap, 95), "n_large_gaps": (gap > np.percentile(gap, 95)).sum(), "persistence_entropy": -(p * np.log(p)).sum()}
    assert {k: got[k] for k in want} == pytest.approx(want)
    known = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "key long, label long")
    row = density.edge_separation(tree, known).first()
    apart = labels[1:] != labels[:-1]
    u = sum((a > b) + 0.5 * (a == b) for a in w[apart] for b in w[~apart])
    assert (row["n_between"], row["u_statistic"]) == (apart.sum(), pytest.approx(u))
    assert row["effect_size"] == pytest.approx(1 - 2 * u / (apart.sum() * (~apart).sum()))


def test_topology(spark):
    x, truth = blobs(25)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(truth)], "key long, label long")
    got = {r["measure"]: r["value"] for r in density.topology(density.Cloud(frame(spark, x), "id", "v", 6), labels, 5, 8).collect()}
    assert got["components"] == 3 and got["purity"] == 1 and got["n_between"] == 2 and got["gap_ratio"] > 2
    assert got["eigenvalue_3"] < 1e-3 < got["eigenvalue_4"]


def test_spectral(spark):
    """A ring with chords: eigenvalues and the space of vectors are NumPy's."""
    pairs = {(i, (i + 1) % 12) for i in range(12)} | {(0, 4), (2, 9), (3, 7)}
    values, vectors = graph.spectral(spark.createDataFrame(list(pairs), "a long, b long"), 3, 12)
    a = np.zeros((12, 12))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    d = a.sum(1)
    want, axes = np.linalg.eigh(np.eye(12) - a / np.sqrt(np.outer(d, d)))
    assert values == pytest.approx(want[:3].tolist(), abs=1e-4)
    v = np.array([r["v"] for r in vectors.orderBy("node").collect()])
    assert np.abs(np.abs(v[:, :2].T @ axes[:, :2]) - np.eye(2)).max() < 1e-3  # up to sign
    assert graph.spectral(spark.createDataFrame([], "a long, b long"), 3)[0] == []


def test_bootstrap_stability(spark):
    x, _ = blobs(25)
    halves = lambda points: points.select("id", (F.col("v")[0] > 3).cast("int").alias("cluster"))
    for r in density.bootstrap_stability(frame(spark, x), "id", halves, 3).collect():
        assert (r["ari"], r["n"] < len(x)) == (1.0, True) and 0.6 < r["jaccard"] <= 1.0
    drawn = lambda points: points.select("id", F.pmod(F.xxhash64("id", F.lit(points.count())), F.lit(3)).alias("cluster"))
    assert all(abs(r["ari"]) < 0.3 for r in density.bootstrap_stability(frame(spark, x), "id", drawn, 3).collect())


def test_manifold_deviations(spark):
    """All rows' scores against NumPy, with a baseline in the middle of which a row has no vector."""
    rng = np.random.default_rng(8)
    base = np.stack([t := rng.uniform(0, 6, 50), np.sin(t), 0.1 * rng.normal(size=50)], 1)
    x = np.concatenate([base, base[:10] + rng.normal(0, 1, (10, 3)), base[:1]])
    df = frame(spark, x).withColumn("control", F.col("id") < 50).unionByName(spark.createDataFrame([(99, None, True)], "id long, v array<double>, control boolean"))
    k, c = 8, 2
    d = np.sqrt(((x[:, None] - base[None]) ** 2).sum(2))
    at = np.argsort(d, 1, kind="stable")[:, :k]
    edges = np.array([w for w in forest([(d[a, b], a, b) for a, b in itertools.combinations(range(50), 2)]).values()])
    spread = np.take_along_axis(d, at, 1).var(1)
    resid, delta = [], []
    for i in range(len(x)):
        around = base[at[at[i, 0]]]
        v = np.linalg.svd(around - around.mean(0), full_matrices=False)[2][:c]
        gap = x[i] - base[at[i, 0]]
        resid.append(np.linalg.norm(gap - gap @ v.T @ v))
        delta.append(max(0.0, (d[i].min() - edges.mean()) / (edges.std() + 1e-10)))
    want = np.stack([resid, delta, np.abs(spread - spread[:50].mean()) / (spread[:50].std() + 1e-10)], 1)
    z = np.median((want - want.mean(0)) / (want.std(0) + 1e-10), 1)
    out = manifold.deviations(df, "id", "v", F.col("control"), k, c, pivots=5)
    got = {r["key"]: r for r in out.collect()}
    assert set(got) == set(range(len(x)))
    for name, col in (("orthogonal_residual", want[:, 0]), ("mst_delta", want[:, 1]), ("knn_curvature", want[:, 2]), ("deviation", z)):
        assert [got[i][name] for i in range(len(x))] == pytest.approx(col.tolist(), abs=1e-9)
    assert manifold.rotation_threshold(out, "deviation", "key", 0.9, 7) == pytest.approx(np.quantile(np.repeat(z, 7), 0.9))
    assert manifold.deviations(df, "id", "v", F.lit(False)).count() == 0


def holed(spark, n=200):
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, n)
    x = np.stack([a, 2 * a + 1 + rng.normal(0, 0.01, n), -a + rng.normal(0, 0.01, n)], 1)
    full, x = x.copy(), x.copy()
    for i in range(n):
        if i % 4 < 3:
            x[i, i % 4] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double"), full


def test_imputation(spark):
    df, full = holed(spark)
    for out in (M.impute_chained(df, "id", ["a", "b", "c"], 3), M.impute_nearest(df, "id", ["a", "b", "c"], df.dropna(), 3)):
        got = np.array([[r["a"], r["b"], r["c"]] for r in out.orderBy("id").collect()])
        assert not np.isnan(got).any() and np.abs(got - full).mean() < 0.1
    shifted = M.impute_chained(df, "id", ["a", "b", "c"], 3, delta=1.0, shifted=["a"]).orderBy("id").collect()
    plain = M.impute_chained(df, "id", ["a", "b", "c"], 3).orderBy("id").collect()
    assert [round(x["a"] - y["a"], 9) for x, y in zip(shifted, plain, strict=True)][:5] == [1, 0, 0, 0, 1]
    r = M.little_statistic(df, ["a", "b", "c"]).first()
    assert r["patterns"] == 4 and r["df"] == 3 + 3 * 2 - 3 and r["statistic"] >= 0


def test_explained_variance(spark):
    df, full = holed(spark)
    rows = [(float(a), float(b), float(c)) for a, b, c in full]
    got = M.explained_variance(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).orderBy("component").collect()
    want = np.linalg.svd(full - full.mean(0))[1] ** 2
    assert [r["share"] for r in got] == pytest.approx((want / want.sum()).tolist(), abs=1e-9)


def test_sleep_by_hand(spark):
    x = [60, 60] + [0] * 200 + [90, 0, 0] + [70] * 3 + [0] * 5
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "u int, t int, v double")
    rows = W.sleep_scores(df, ["u"], ["t"], "v").orderBy("t").collect()
    for i in (0, 3, 100, 201, len(x) - 1):
        part = np.array(x[max(0, i - 5) : i + 6], float)
        score = 7.601 - 0.065 * (part >= 50).sum() - 0.056 * part.mean() - 0.703 * part.std() - 1.08 * np.log(part[5] + 1)
        assert rows[i]["sadeh"] == pytest.approx(score) and rows[i]["sadeh_asleep"] == (score >= 0)
        p = [0.00001, 0.04, 1.0, 0.04, 0.0001, 0.0001, 0.0004, 0.02]
        d = sum(w * x[i + j - 2] for j, w in enumerate(p) if 0 <= i + j - 2 < len(x)) / 100
        assert rows[i]["cole"] == pytest.approx(1 / (1 + np.exp(0.37 - 0.73 * d)))
    found = W.sleep_periods(df, ["u"], ["t"], df.v < 10, 1.0).collect()
    assert [(r["onset"], r["offset"], r["minutes"]) for r in found] == [(2, 202, 200.0)]  # the last run's end is unseen
    q = W.sleep_quality(df, ["u"], ["t"], "v", df.v < 10, 1.0).first()
    assert (q["tst"], q["tib"], q["se"], q["waso"], q["sol"], q["awakenings"], q["sfi"]) == (200, 200, 100, 0, 0, 0, 0)


def test_preranked(spark):
    rng = np.random.default_rng(3)
    score = np.sort(rng.normal(0, 1, 200))[::-1]
    rows = [(i, float(score[i]), "top" if i < 20 else "low" if i >= 180 else "rest") for i in range(200)]
    got = {r["set"]: r for r in W.preranked(spark.createDataFrame(rows, "gene long, score double, set string"), "gene", "score", "set", 200).collect()}
    assert got["top"]["es"] == pytest.approx(1) and got["top"]["p"] < 0.02 and got["top"]["nes"] > 1.5
    assert got["low"]["es"] == pytest.approx(-1) and got["low"]["nes"] < -1.5


def test_vote_matches_sql(spark, tmp_path):
    """Ties go to the smallest label; missing labels, vectors and components count in the share but don't win over a label."""
    import duckdb

    from quillon import registry

    rows = [(1, [1.0, 1.0, -1.0, 1.0], 3), (2, [1.0, -1.0, -1.0, 1.0], 0), (3, [1.0], None), (4, None, 2), (5, None, None), (6, [1.0, 1.0, 1.0, 1.0], None), (7, [], -4), (None, [0.0, 0.0, float("nan"), 1.0], 9), (8, [None, 1.0, 1.0, -1.0], 2)]
    rows += [(1, [-1.0, 1.0, 1.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = collections.Counter(duck.execute(registry.ORACLES["M16_vote_confidence"]).fetchall())
    assert collections.Counter(tuple(r) for r in registry.QUERIES["M16_vote_confidence"](spark, str(tmp_path)).collect()) == want


def test_nearest_visits_few_blocks(spark, monkeypatch):
    """What is exchanged follows the rows, not the pairs of blocks: also with half of all rows at one place."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full((600, 2), 0.5), rng.random((600, 2))])
    sent, visiting = [], neighbours.Cells.visiting
    monkeypatch.setattr(neighbours.Cells, "visiting", lambda *a: sent.append(visiting(*a)) or sent[-1])
    cells = neighbours.Cells(frame(spark, x), "id", "v", 4)
    monkeypatch.setattr(neighbours, "dropped", lambda *a: None)
    near, far = plain.neighbour_distances(x, 4)
    assert {(r["key"], r["rank"]): (r["neighbour"], r["distance"]) for r in neighbours.nearest(cells, 4).collect()} == {(i, j + 1): (near[i, j], far[i, j]) for i in range(len(x)) for j in range(4)}
    assert sum(r["n"] for s in sent for r in s.selectExpr("size(to) AS n").collect()) < 8 * len(x)  # all pairs of 60 blocks: 60 a row


def test_preranked_over_chunks(spark, monkeypatch):
    """A ranking of many chunks, which no task holds whole, scores its sets as one of a single chunk does."""
    monkeypatch.setattr(W, "CHUNK", 37)
    rng = np.random.default_rng(6)
    score = np.sort(rng.normal(0, 1, 200))[::-1]
    sets = {"a": sorted(rng.choice(200, 30, replace=False).tolist()), "low": list(range(150, 200)), "one": [120]}
    rows = [(i, float(score[i]), n) for n, at in sets.items() for i in at] + [(i, float(score[i]), "all") for i in range(200)]
    got = {r["set"]: r for r in W.preranked(spark.createDataFrame(rows, "gene long, score double, set string"), "gene", "score", "set", 60).collect()}
    for n, at in sets.items():
        run, best = 0.0, 0.0
        for i in range(200):
            run += abs(score[i]) / sum(abs(score[at])) if i in at else -1 / (200 - len(at))
            best = run if abs(run) > abs(best) else best
        assert (got[n]["size"], got[n]["es"]) == (len(at), pytest.approx(best))
    assert got["low"]["p"] < 0.1 and got["low"]["nes"] < -1.3 and got["all"]["es"] == pytest.approx(1)
