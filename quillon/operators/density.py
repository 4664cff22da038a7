"""Density clustering and separation of point clouds by spanning trees, without collecting points.

Exact neighbours give core distances and an edge table; Borůvka's rounds turn its
mutual reachability distances into the minimum spanning tree, and search anew where
the table can't prove that it holds a part's closest pair. The hierarchy of density
(HDBSCAN, Campello et al. 2013) is read off the tree at a ladder of levels, all of
which one run of connected components cuts at once: a cluster is a chain of
components of `least` rows on, from the level where it splits off to the one where
it splits itself or fades, and the excess of mass chooses among nested ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import graph as G
from quillon.operators.neighbours import Cells, closest_outside, nearest
from quillon.sources.shared import dropped, stored


class Cloud:
    """A point cloud with its neighbour table, from which trees of several core sizes are made.

    Keys are unique whole numbers; rows with a null key or vector are left out.
    """

    def __init__(self, points: DataFrame, key: str, vector: str, k: int = 15, pivots: int | None = None):
        self.k, self.cells = k, Cells(points, key, vector, k, pivots)
        self.near = nearest(self.cells, k)

    def core(self, neighbours: int) -> DataFrame:
        """(key, core): the distance to the neighbours-th other row, or to the last one."""
        if neighbours > self.k:
            raise ValueError(f"{self.k} neighbours are known")
        return self.near.filter(F.col("rank") <= neighbours).groupBy("key").agg(F.max("distance").alias("core"))

    def tree(self, neighbours: int = 0) -> DataFrame:
        """(a, b, w): the minimum spanning tree of mutual reachability distances; of plain distances with 0 neighbours.
        Lists of neighbours give most edges; rows whose lists may miss a part's closest pair are searched anew. Stored."""
        far = self.near.groupBy("key").agg(F.max("distance").alias("reach"))
        core = self.core(neighbours) if neighbours else far.select("key", F.lit(0.0).alias("core"))
        bounds = stored(self.cells.rows.select("key").join(core, "key", "left").join(far, "key", "left").select("key", F.coalesce("core", F.lit(0.0)).alias("core"), F.greatest("core", "reach").alias("reach")))
        ends = bounds.select(F.col("key").alias("a"), F.col("core").alias("ca")), bounds.select(F.col("key").alias("b"), F.col("core").alias("cb"))
        edges = self.near.select(F.col("key").alias("a"), F.col("neighbour").alias("b"), "distance").join(ends[0], "a").join(ends[1], "b")
        weighted = edges.select("a", "b", F.greatest("distance", "ca", "cb").alias("w"))
        out = G.spanning_forest(weighted, self.cells.rows.select(F.col("key").alias("node")), lambda parts, picked: closest_outside(self.cells, parts, picked, bounds))
        dropped(bounds)
        return out


def ladder(tree: DataFrame, levels: int = 16, top: int = 64) -> list[float]:
    """Ascending distances at which a tree is cut: `levels` quantiles of its edges, and the longest edge, the second
    longest, the fourth and so on, where few edges decide."""
    longest = [r["w"] for r in tree.orderBy(F.desc("w")).limit(top).select("w").collect()]
    ends = {longest[2**i] for i in range(top.bit_length()) if 2**i < len(longest)} | set(longest[:1])
    shares = [i / levels for i in range(1, levels)]
    middle = tree.agg(F.percentile_approx("w", F.array(*map(F.lit, shares)), 100_000).alias("q")).first()["q"] or []
    return sorted(ends | set(middle))


def memberships(tree: DataFrame, cuts: list[float]) -> DataFrame:
    """(level, node, component) of the tree's edges up to each cut; the last level, the root, joins all. Stored."""
    steps = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(float(c)).alias("cut")) for i, c in enumerate(cuts)))
    below = tree.select("a", "b", "w", F.inline(steps)).filter(F.col("w") <= F.col("cut"))
    root = tree.select("a", "b", F.lit(len(cuts)).alias("level"))
    return G.components(below.select("a", "b", "level").unionByName(root), ("level",))


def chains(member: DataFrame, cuts: list[float], least: int) -> DataFrame:
    """The condensed hierarchy, a row a cluster: (cluster, level, component, size, parent, own, root); `own` is its
    excess of mass. Components under `least` rows are noise. Stored."""
    big = stored(member.groupBy("level", "component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least))
    above = member.select((F.col("level") - 1).alias("level"), F.col("node").alias("component"), F.col("component").alias("up"))
    linked = big.join(above, ["level", "component"], "left")
    sisters = linked.groupBy("level", "up").agg(F.count(F.lit(1)).alias("sisters"))
    density = [1.0 / max(c, 1e-12) for c in cuts]
    gain = F.element_at(F.array(*(F.lit(a - b) for a, b in zip(density, [*density[1:], 0.0], strict=True))), F.col("level") + 1) if cuts else F.lit(0.0)
    name = lambda level, c: F.struct(level.alias("l"), F.col(c).alias("c"))
    rows = stored(
        linked.join(sisters, ["level", "up"], "left")
        .withColumn("starts", F.col("up").isNull() | (F.col("sisters") > 1))
        .select(name(F.col("level"), "component").alias("id"), "size", F.when(F.col("up").isNotNull(), name(F.col("level") + 1, "up")).alias("over"), "starts", F.when(F.col("level") < len(cuts), F.col("size") * gain).otherwise(0.0).alias("mass"))
    )
    # Each component points at the one its cluster starts with: pointer jumping over at most len(cuts) levels.
    to = stored(rows.select("id", F.when(F.col("starts"), F.col("id")).otherwise(F.col("over")).alias("to")))
    for _ in range(max(1, len(cuts)).bit_length()):
        after = stored(to.join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
        dropped(to)
        to = after
    own = rows.join(to, "id").groupBy(F.col("to").alias("cluster")).agg(F.sum("mass").alias("own"))
    first = rows.filter("starts").select(F.col("id").alias("cluster"), "size", F.col("over").alias("id"))
    out = stored(first.join(to, "id", "left").join(own, "cluster").select("cluster", F.col("cluster.l").alias("level"), F.col("cluster.c").alias("component"), "size", F.col("to").alias("parent"), "own", F.col("to").isNull().alias("root")))
    dropped(big, rows, to)
    return out


def chosen(clusters: DataFrame, method: str = "eom") -> DataFrame:
    """The chains() rows whose own mass is at least that of the best clusters below them (`eom`; nested ones too: the
    outermost counts), or those that don't split (`leaf`). The root never is one. Stored."""
    if method == "leaf":
        return stored(clusters.filter("not root").join(clusters.select(F.col("parent").alias("cluster")).dropna().distinct(), "cluster", "left_anti"))
    if method != "eom":
        raise ValueError("method is eom or leaf")
    parents = clusters.groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("n")).dropna()
    open_, done = clusters.join(parents, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0))), []
    open_ = stored(open_)
    while not open_.isEmpty():
        known = reduce(DataFrame.unionByName, done).groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("m"), F.sum("total").alias("below")) if done else clusters.select("cluster", F.lit(0).alias("m"), F.lit(0.0).alias("below")).limit(0)
        met = open_.join(known, "cluster", "left").withColumn("ready", F.coalesce("m", F.lit(0)) == F.col("n"))
        level = stored(met.filter("ready").withColumn("below", F.coalesce("below", F.lit(0.0))).select(*clusters.columns, (F.col("own") >= F.col("below")).alias("wins"), F.greatest("own", "below").alias("total")))
        rest = stored(met.filter("not ready").select(open_.columns))
        done.append(level)
        dropped(open_)
        open_ = rest
    out = stored(reduce(DataFrame.unionByName, done).filter("wins and not root").select(clusters.columns)) if done else clusters
    dropped(*done)
    return out


def labelled(cloud: Cloud, member: DataFrame, winners: DataFrame) -> DataFrame:
    """(key, cluster): for every row the smallest key of its outermost winner, or -1 for noise. Stored."""
    mine = member.join(winners.select("level", "component"), ["level", "component"]).groupBy("node").agg(F.max_by("component", "level").alias("cluster"))
    return stored(cloud.cells.rows.select("key").join(mine.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("cluster", F.lit(-1)).alias("cluster")))


def density_clusters(points: DataFrame, key: str, vector: str, least: int = 10, neighbours: int = 5, k: int = 15, levels: int = 16, method: str = "eom") -> DataFrame:
    """(key, cluster) for every row: clusters of density of `least` rows on, -1 is noise."""
    cloud = Cloud(points, key, vector, max(k, neighbours))
    tree = cloud.tree(neighbours)
    cuts = ladder(tree, levels)
    member = memberships(tree, cuts)
    return labelled(cloud, member, chosen(chains(member, cuts, least), method))


def sweep(cloud: Cloud, least: tuple[int, ...] = (5, 10, 20), neighbours: tuple[int, ...] = (1, 5, 10), methods: tuple[str, ...] = ("eom", "leaf"), levels: int = 16) -> DataFrame:
    """(run, least, neighbours, method, key, cluster) for all combinations; a tree and its levels serve several runs."""
    runs = []
    for n in neighbours:
        tree = cloud.tree(n)
        cuts = ladder(tree, levels)
        member = memberships(tree, cuts)
        for size in least:
            found = chains(member, cuts, size)
            for method in methods:
                out = labelled(cloud, member, chosen(found, method))
                runs.append(out.select(F.lit(len(runs)).alias("run"), F.lit(size).alias("least"), F.lit(n).alias("neighbours"), F.lit(method).alias("method"), "key", "cluster"))
    return reduce(DataFrame.unionByName, runs)


def consensus(cloud: Cloud, runs: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """(key, cluster, confidence) over runs with two clusters at least.

    Neighbours that share a cluster in at least `share` of these runs are linked; linked groups of `least` rows on are
    clusters, named by their smallest key, the rest is -1. Confidence: the mean share with the row's neighbours in the
    own cluster. Only pairs of neighbours are compared, so nothing grows with the square of a cluster.
    """
    valid = runs.filter("cluster >= 0").groupBy("run").agg(F.count_distinct("cluster").alias("n")).filter("n > 1").select("run")
    held = stored(runs.join(F.broadcast(valid), "run").select("run", "key", "cluster"))
    pairs = cloud.near.select(F.col("key").alias("a"), F.col("neighbour").alias("b"))
    left, right = held.filter("cluster >= 0").select("run", F.col("key").alias("a"), "cluster"), held.select("run", F.col("key").alias("b"), "cluster")
    total = max(1, held.select("run").distinct().count())
    shares = stored(pairs.join(left, "a").join(right, ["run", "b", "cluster"]).groupBy("a", "b").agg((F.count(F.lit(1)) / total).alias("share")))
    groups = G.components(shares.filter(F.col("share") >= share).select("a", "b"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    mine = groups.join(sizes, "component").select("node", "component")
    to = mine.select(F.col("node").alias("b"), F.col("component").alias("other"))
    sure = shares.join(mine.withColumnRenamed("node", "a"), "a").join(to, "b").filter("component = other").groupBy(F.col("a").alias("key")).agg(F.avg("share").alias("confidence"))
    rows = cloud.cells.rows.select("key").join(mine.withColumnRenamed("node", "key"), "key", "left").join(sure, "key", "left")
    return rows.select("key", F.coalesce("component", F.lit(-1)).alias("cluster"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def placed(df: DataFrame, order: list) -> DataFrame:
    """df with `place` from 0 on by an order without ties; ranges of the order are numbered in tasks of their own. Stored."""
    ranged = stored(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before, starts = 0, []
    for r in ranged.groupBy("range").count().orderBy("range").collect():
        starts.append((r["range"], before))
        before += r["count"]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "range int, first long"))
    out = stored(ranged.join(first, "range").withColumn("place", F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1).drop("range", "first"))
    dropped(ranged)
    return out


def tree_gaps(tree: DataFrame) -> DataFrame:
    """One row over the tree's edges by length: mean of the shorter half and of the longer, their ratio, the largest gap
    between consecutive lengths, the 95th percentile of gaps, the gaps above it, and the entropy of the lengths'
    shares, which are the lifetimes of the parts (persistence of order 0; edges of no length have none)."""
    n = tree.count()
    e = placed(tree, [F.col("w"), F.col("a"), F.col("b")])
    gaps = e.join(e.select((F.col("place") + 1).alias("place"), F.col("w").alias("before")), "place").select((F.col("w") - F.col("before")).alias("gap"))
    limit = gaps.agg(F.percentile("gap", F.lit(0.95)).alias("gap_threshold"), F.max("gap").alias("max_gap"))
    over = gaps.crossJoin(F.broadcast(limit)).agg(F.count_if(F.col("gap") > F.col("gap_threshold")).alias("n_large_gaps"))
    half = n // 2
    means = e.agg(F.avg(F.when(F.col("place") < half, F.col("w"))).alias("mean_within"), F.avg(F.when(F.col("place") >= half, F.col("w"))).alias("mean_between"), F.sum("w").alias("weight"))
    share = F.col("w") / F.col("weight")
    entropy = e.crossJoin(F.broadcast(means.select("weight"))).filter("w > 0").agg((-F.sum(share * F.log(share))).alias("persistence_entropy"))
    row = means.crossJoin(limit).crossJoin(over).crossJoin(entropy)
    return row.withColumn("gap_ratio", F.when(F.col("mean_within") > 0, F.col("mean_between") / F.col("mean_within")).otherwise(1.0))


def edge_separation(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: are edges between labels (key, label) longer than those within? Counts, means, Mann-Whitney's U of the
    between edges, its normal p (greater, corrected for ties and continuity) and the rank-biserial 1 - 2U / (n1 n2)."""
    on = lambda side, name: labels.select(F.col("key").alias(side), F.col("label").alias(name))
    e = tree.join(on("a", "la"), "a").join(on("b", "lb"), "b").select("w", (~F.col("la").eqNullSafe(F.col("lb"))).alias("between"))
    # Equal lengths share their mean rank: counted by length first, then numbered by ranges.
    by = placed(e.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if("between").alias("m")).withColumn("a", F.lit(0)), [F.col("w")])
    parts = by.withColumn("part", F.floor(F.col("place") / 4096))
    before = parts.groupBy("part").agg(F.sum("n").alias("s"))
    reach = before.withColumn("below", F.sum("s").over(Window.orderBy("part")) - F.col("s")).select("part", "below")  # a row for 4096 lengths
    ranked = parts.join(reach, "part").withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("part").orderBy("w"))).withColumn("mean_rank", F.col("upto") - (F.col("n") - 1) / 2)
    s = ranked.agg(F.sum(F.col("m") * F.col("mean_rank")).alias("r1"), F.sum("m").cast("double").alias("n1"), F.sum(F.col("n") - F.col("m")).cast("double").alias("n2"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties"), F.sum(F.col("w") * F.col("m")).alias("wb"), F.sum(F.col("w") * (F.col("n") - F.col("m"))).alias("ww"))
    n, both = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    s = s.withColumn("u_statistic", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(both / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.col("u_statistic") - both / 2 - 0.5) / sd
    return s.select(F.col("n1").cast("long").alias("n_between"), F.col("n2").cast("long").alias("n_within"), (F.col("wb") / F.col("n1")).alias("between_mean"), (F.col("ww") / F.col("n2")).alias("within_mean"), "u_statistic", z.alias("z"), (1 - 2 * F.col("u_statistic") / both).alias("effect_size"))


def purity(near: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean share of a row's neighbours that have its label, over rows (key, label)."""
    on = lambda side, name: labels.select(F.col("key").alias(side), F.col("label").alias(name))
    same = near.select("key", "neighbour").join(on("key", "l"), "key").join(on("neighbour", "m"), "neighbour").select("key", F.col("l").eqNullSafe(F.col("m")).cast("int").alias("same"))
    return same.groupBy("key").agg(F.avg("same").alias("p")).agg(F.avg("p").alias("purity"))


def vote(runs: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, confidence): each key's most frequent label over runs (the smallest of equals, NULL only if there is no other) and the largest share."""
    n = runs.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.when(F.col(label).isNotNull(), F.struct("_n", -F.col(label)))
    return n.groupBy(key).agg(F.max_by(label, rank).alias("label"), (F.max("_n") / F.sum("_n")).alias("confidence"))


def bootstrap_stability(points: DataFrame, key: str, clusterer, draws: int = 10, share: float = 0.8, seed: int = 11) -> DataFrame:
    """(draw, n, ari, jaccard): how a clustering of all rows comes back in subsamples of it, drawn by a hash of the key.

    clusterer is the user's: from points to (key, cluster), under zero for noise, as a plan. ari: the adjusted Rand index
    of both clusterings on the rows drawn; jaccard: the mean over the first clustering's clusters of the best overlap.
    """
    base = stored(clusterer(points).select(F.col(key).alias("key"), F.col("cluster").alias("c")))
    pairs2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    out = []
    for d in range(draws):
        own = points.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed + d)), F.lit(1 << 20)) < share * (1 << 20))
        both = clusterer(own).select(F.col(key).alias("key"), F.col("cluster").alias("k")).join(base, "key")
        cells = stored(both.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")))
        rows, cols = cells.groupBy("c").agg(F.sum("n").alias("a")), cells.groupBy("k").agg(F.sum("n").alias("b"))
        index = cells.agg(pairs2("n").alias("s"), F.sum("n").alias("n")).crossJoin(rows.agg(pairs2("a").alias("sa"))).crossJoin(cols.agg(pairs2("b").alias("sb")))
        expected, most = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2), (F.col("sa") + F.col("sb")) / 2
        best = cells.filter("c >= 0 AND k >= 0").join(rows, "c").join(cols, "k").groupBy("c").agg(F.max(F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("j"))
        found = rows.filter("c >= 0").join(best, "c", "left").agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("jaccard"))
        out.append(index.crossJoin(found).select(F.lit(d).alias("draw"), "n", F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"), "jaccard"))
    return reduce(DataFrame.unionByName, out)


def topology(cloud: Cloud, labels: DataFrame | None = None, dims: int = 10, rounds: int = 20) -> DataFrame:
    """(measure, value): of the spanning tree, its edges between labels (key, label), the neighbours' purity, and of the
    neighbour graph its connected parts, its smallest normalised Laplacian eigenvalues and their largest gap."""
    tree = cloud.tree()
    edges = stored(cloud.near.select(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b")).distinct())
    values, _ = G.spectral(edges, dims, rounds)
    spark = edges.sparkSession
    inside = G.components(edges)
    parts = inside.select("component").distinct().count() + cloud.cells.n - inside.count()
    spread = [(f"eigenvalue_{i + 1}", float(v)) for i, v in enumerate(values)] + [("spectral_gap", max((b - a for a, b in zip(values, values[1:], strict=False)), default=0.0)), ("components", float(parts))]
    wide = [tree_gaps(tree)] + ([edge_separation(tree, labels), purity(cloud.near, labels)] if labels is not None else [])
    long = [w.select(F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in w.columns)))) for w in wide]
    return reduce(DataFrame.unionByName, long).unionByName(spark.createDataFrame([(m, float(v)) for m, v in spread], "measure string, value double"))
