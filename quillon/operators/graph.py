"""Graphs as edge tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import dropped, stored


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Degree of each node; a loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array(a, b))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, a: str, b: str, quantile: float) -> DataFrame:
    d = degrees(edges, a, b)
    return d.crossJoin(d.agg(F.percentile("degree", F.lit(quantile)).alias("_q"))).filter(F.col("degree") >= F.col("_q")).drop("_q")


def closure(edges: DataFrame, child: str, parent: str, most: int = 50) -> DataFrame:
    """(node, ancestor, depth) by squaring-free expansion of the frontier until nothing is new; one join a level. More than `most` levels are an error."""
    base = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct()
    step = base.toDF("ancestor", "next")
    out, front, depth = base.withColumn("depth", F.lit(1)), base, 1
    while True:
        depth += 1
        front = front.join(step, "ancestor").select("node", F.col("next").alias("ancestor")).distinct().join(out, ["node", "ancestor"], "left_anti")
        if front.isEmpty():
            break
        if depth > most:
            raise ValueError(f"ancestors more than {most} levels away")
        out = out.unionByName(front.withColumn("depth", F.lit(depth)))
    return out


def page_rank(edges: DataFrame, source: str, target: str, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Fixed rounds of power iteration; nodes without out-edges spread nothing."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    out = e.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    nodes = e.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    e, rank = e.join(out, "s"), nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        given = e.join(rank, F.col("s") == F.col("node")).groupBy("t").agg(F.sum(F.col("rank") / F.col("k")).alias("g"))
        rank = nodes.join(given, F.col("node") == F.col("t"), "left").select("node", ((1 - damping) + damping * F.coalesce("g", F.lit(0.0))).alias("rank"))
    return rank


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, component): the smallest node that each node of the edges (*by, a, b) reaches, within each group `by`.

    Rounds of linking to the smallest neighbour and of pointer jumping; rounds grow with the logarithm of the longest
    path. Nodes without an edge to another node aren't listed. A stored table.
    """
    by = list(by)
    both = edges.filter("a <> b").select(*by, F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    links = stored(both.distinct())
    label = stored(links.groupBy(*by, "u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        # Each label takes the smallest label next to any of its nodes, then the label of that label.
        near = links.join(label.withColumnRenamed("u", "v"), [*by, "v"]).groupBy(*by, "u").agg(F.min("c").alias("n"))
        hung = label.join(near, [*by, "u"]).select(*by, "u", "c", F.least("c", "n").alias("n"))
        lowest = stored(hung.groupBy(*by, "c").agg(F.min("n").alias("n")))
        jumped = lowest.join(lowest.select(*by, F.col("c").alias("n"), F.col("n").alias("m")), [*by, "n"], "left").select(*by, "c", F.least("n", F.coalesce("m", "n")).alias("n"))
        moved = lowest.filter("n < c").isEmpty()
        if moved:
            dropped(lowest, links)
            return label.withColumnsRenamed({"u": "node", "c": "component"})
        after = stored(label.join(jumped, [*by, "c"]).select(*by, "u", F.col("n").alias("c")))
        dropped(label, lowest)
        label = after


def spanning_forest(edges: DataFrame, nodes: DataFrame | None = None, closer=None) -> DataFrame:
    """(a, b, w), a < b: the minimum spanning forest of weighted edges (a, b, w), by Borůvka's rounds. A stored table.

    In a round every part takes its lightest edge to another part, the parts that these join become one, and of
    parallel edges the lightest stays. Equal weights go by (a, b), so that the forest is unique. Loops and rows with
    a null are ignored.

    With nodes (node) and closer, edges that aren't listed count too: closer(parts, picked) gets (node, part) and the
    round's lightest listed edges (part, w, a, b, other). It returns (part, w, a, b) of the parts with an edge as light
    or lighter, and the part that it left out, which picks nothing in this round: the others pick their edges to it.
    """
    spark = edges.sparkSession
    least = lambda *cols: F.min(F.struct(*cols))
    e = edges.dropna(subset=["a", "b", "w"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w"))
    left = stored(e.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("p"), F.col("b").alias("q"), "a", "b", "w"))
    parts = stored(nodes.select("node", F.col("node").alias("part"))) if closer else None
    forest = []
    while True:
        ends = F.inline(F.array(F.struct(F.col("p").alias("part"), F.col("q").alias("other")), F.struct(F.col("q").alias("part"), F.col("p").alias("other"))))
        picked = stored(left.select("a", "b", "w", ends).groupBy("part").agg(least("w", "a", "b", "other").alias("m")).select("part", "m.*"))
        if closer:
            of = lambda node, part: parts.select(F.col("node").alias(node), F.col("part").alias(part))  # noqa: B023, E731
            more, largest = closer(parts, picked)
            more = more.join(of("a", "pa"), "a").join(of("b", "pb"), "b").select("part", "w", "a", "b", F.when(F.col("pa") == F.col("part"), F.col("pb")).otherwise(F.col("pa")).alias("other"))
            listed, picked = picked, stored(picked.filter(F.col("part") != largest).unionByName(more).groupBy("part").agg(least("w", "a", "b", "other").alias("m")).select("part", "m.*"))
            dropped(listed)
        if picked.isEmpty():
            break
        forest.append(stored(picked.select("a", "b", "w").distinct()))
        back = picked.select(F.col("part").alias("other"), F.col("other").alias("again"))
        # A part whose pick isn't answered hangs below the other; of two that pick each other the smaller is the root,
        # as is one that picked nothing.
        hung = picked.select("part", "other").join(back, "other", "left").select("part", F.when((F.col("again") == F.col("part")) & (F.col("part") < F.col("other")), F.col("part")).otherwise(F.col("other")).alias("root"))
        up = stored(hung.unionByName(picked.select(F.col("other").alias("part")).distinct().join(picked, "part", "left_anti").select("part", F.col("part").alias("root"))))
        while True:
            above = up.select(F.col("part").alias("root"), F.col("root").alias("next"))
            twice = up.join(above, "root").select("part", F.col("root").alias("was"), F.col("next").alias("root")).join(above, "root")
            after = stored(twice.select("part", F.col("next").alias("root"), (F.col("next") != F.col("was")).alias("moved")))
            still = after.filter("moved").isEmpty()
            dropped(up)
            up = after
            if still:
                break
        roots = up.drop("moved")
        to = lambda side: roots.select(F.col("part").alias(side), F.col("root").alias(f"{side}_"))  # noqa: B023, E731
        now = lambda side: F.coalesce(f"{side}_", side)
        merged = left.join(to("p"), "p", "left").join(to("q"), "q", "left").select(now("p").alias("x"), now("q").alias("y"), "a", "b", "w").filter("x <> y")
        smaller = stored(merged.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(least("w", "a", "b").alias("m")).select("p", "q", "m.a", "m.b", "m.w"))
        if closer:
            joined = stored(parts.join(roots, "part", "left").select("node", F.coalesce("root", "part").alias("part")))
            dropped(parts)
            parts = joined
        dropped(left, picked, up)
        left = smaller
    dropped(left, picked)
    if not forest:
        return spark.createDataFrame([], "a long, b long, w double")
    out = stored(reduce(DataFrame.unionByName, forest).distinct())
    dropped(*forest)
    return out


def _vectors(batch, name: str) -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel()))


def _ritz(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the `dims` best vectors in the space of the columns s, of which t are the images; their values.
    Tasks send the sums of their rows: two matrices of at most 3 dims by 3 dims."""

    def sums(batches):
        for b in batches:
            s, t = _vectors(b, "s"), _vectors(b, "t")
            yield pa.RecordBatch.from_arrays([_lists((s.T @ s).reshape(1, -1)), _lists((s.T @ t).reshape(1, -1))], names=["g", "h"])

    got = rows.select("s", "t").mapInArrow(sums, "g array<double>, h array<double>").collect()
    side = math.isqrt(len(got[0]["g"]))
    g, h = (np.sum([r[c] for r in got], axis=0).reshape(side, side) for c in ("g", "h"))
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    size, axes = np.linalg.eigh(g * scale[:, None] * scale)
    live = size > 1e-10  # columns that others span have no direction of their own
    turn = scale[:, None] * axes[:, live] / np.sqrt(size[live])
    values, best = np.linalg.eigh(turn.T @ ((h + h.T) / 2) @ turn)
    return turn @ best[:, ::-1][:, :dims], values[::-1][:dims]


def spectral(edges: DataFrame, dims: int = 10, rounds: int = 20, seed: int = 5) -> tuple[list[float], DataFrame]:
    """The smallest `dims` eigenvalues of the normalised Laplacian of undirected edges (a, b), ascending, and
    (node, v): the nodes' eigenvectors, of length 1 over all nodes.

    Blocks of conjugate directions (LOBPCG, Knyazev 2001) on (I + D^-1/2 A D^-1/2) / 2, which has the same vectors. A
    round is one join of edges with their ends' residuals and one sum by node; the driver sees matrices of 3 dims by
    3 dims. Start vectors are hashes of nodes, so that a run can be repeated.
    """
    both = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(both.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).cast("double").alias("d"))
    links = stored(both.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v").select("u", "v", (0.5 / F.sqrt(F.col("d") * F.col("e"))).alias("w")))

    def pushed(rows: DataFrame, k: int) -> DataFrame:
        """rows (u, s, t, r) with the image of r appended to t, and r to s."""
        image = links.join(rows.select(F.col("u").alias("v"), "r"), "v").groupBy("u").agg(*(F.sum(F.col("w") * F.col("r")[i]).alias(f"y{i}") for i in range(k)))
        own = F.array(*(F.col("r")[i] / 2 + F.coalesce(f"y{i}", F.lit(0.0)) for i in range(k)))
        return stored(rows.join(image, "u", "left").select("u", F.concat("s", "r").alias("s"), F.concat("t", own).alias("t")))

    def turned(rows: DataFrame, c: np.ndarray, values: np.ndarray) -> DataFrame:
        """The best vectors with their images, the directions that led to them, and the residuals r."""
        k = c.shape[1]

        def each(batches):
            for b in batches:
                s, t = _vectors(b, "s"), _vectors(b, "t")
                x, ax, p, ap = s @ c, t @ c, s[:, k:] @ c[k:], t[:, k:] @ c[k:]
                led = s.shape[1] > k
                yield pa.RecordBatch.from_arrays([b.column("u"), _lists(np.hstack([x, p]) if led else x), _lists(np.hstack([ax, ap]) if led else ax), _lists(ax - x * values)], names=["u", "s", "t", "r"])

        return rows.mapInArrow(each, "u long, s array<double>, t array<double>, r array<double>")

    none = F.array().cast("array<double>")
    start = F.array(*(F.xxhash64("u", F.lit(seed + i)).cast("double") / float(1 << 63) for i in range(dims)))
    rows = pushed(stored(degree.select("u", none.alias("s"), none.alias("t"), start.alias("r"))), dims)
    if rows.isEmpty():
        return [], rows.select(F.col("u").alias("node"), F.col("s").alias("v"))
    c, values = _ritz(rows, dims)
    for _ in range(rounds):
        made = stored(turned(rows, c, values))
        after = pushed(made, c.shape[1])
        dropped(rows, made)
        rows = after
        c, values = _ritz(rows, c.shape[1])
    out = stored(turned(rows, c, values).select(F.col("u").alias("node"), F.slice("s", 1, c.shape[1]).alias("v")))
    dropped(both, links, rows)
    return [max(0.0, float(2 - 2 * v)) for v in values], out
