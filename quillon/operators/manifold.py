"""How far rows lie from the manifold of a baseline.

Three measures, each a z over all rows, and their median: the distance to the
tangent space of the nearest baseline row, the length of the step to it against the
baseline's spanning tree, and the spread of distances to the nearest baseline rows
against the baseline's own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.density import Cloud, placed
from quillon.operators.neighbours import matrix, nearest
from quillon.sources.shared import dropped, stored


def tangents(rows: DataFrame, near: DataFrame, components: int) -> DataFrame:
    """(key, base): the first principal axes, end to end, of each row's neighbours in near (key, neighbour).

    rows: (key, x). A row's neighbours are bounded by their number, so that they are one array.
    """
    around = near.join(rows.select(F.col("key").alias("neighbour"), "x"), "neighbour").groupBy("key").agg(F.collect_list("x").alias("xs"))

    def axes(batches):
        for batch in batches:
            keys, out = batch.column("key"), []
            for xs in batch.column("xs").to_pylist():
                x = np.array(xs)
                _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
                out.append(v[: min(components, *x.shape)].ravel())
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.list_(pa.float64()))], names=["key", "base"])

    return around.mapInArrow(axes, "key long, base array<double>")


def deviations(points: DataFrame, key: str, vector: str, control: Column, k: int = 15, components: int = 5, pivots: int | None = None) -> DataFrame:
    """(key, orthogonal_residual, mst_delta, knn_curvature, deviation) of every row with a key and a vector. Stored.

    The baseline is the rows that meet control (null: not met); a baseline row is its own nearest one. mst_delta counts
    only steps longer than the tree's mean edge; edges of no length aren't edges. knn_curvature compares with the mean
    and deviation over all baseline rows. Without baseline rows there is no result; a column of one value has z 0.
    """
    base = Cloud(points.filter(control), key, vector, k, pivots)
    own = base.cells.rows.select("key", "x")
    if base.cells.n == 0:
        return points.sparkSession.createDataFrame([], "key long, orthogonal_residual double, mst_delta double, knn_curvature double, deviation double")
    every = stored(points.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x")).dropna())
    near = nearest(base.cells, min(k, base.cells.n), every)
    inside = near.join(own.select("key"), "key", "left_semi").select("key", "neighbour")
    bases = tangents(own, inside, components)
    first = near.filter("rank = 1").select("key", "neighbour", F.col("distance").alias("step"))
    met = every.join(first, "key").join(own.select(F.col("key").alias("neighbour"), F.col("x").alias("at")), "neighbour").join(bases.withColumnRenamed("key", "neighbour"), "neighbour")

    def residuals(batches):
        for b in batches:
            if b.num_rows:
                gap = matrix(b.column("x")) - matrix(b.column("at"))
                v = matrix(b.column("base")).reshape(b.num_rows, -1, gap.shape[1])
                rest = gap - np.einsum("ic,icd->id", np.einsum("id,icd->ic", gap, v), v)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("step"), pa.array(np.sqrt((rest**2).sum(1)))], names=["key", "step", "orthogonal_residual"])

    resid = met.select("key", "step", "x", "at", "base").mapInArrow(residuals, "key long, step double, orthogonal_residual double")
    tree = base.tree()
    edges = tree.filter("w > 0").agg(F.avg("w").alias("tree_mean"), F.stddev_pop("w").alias("tree_std"))
    spread = near.groupBy("key").agg(F.var_pop("distance").alias("spread"))
    usual = spread.join(own.select("key"), "key", "left_semi").agg(F.avg("spread").alias("spread_mean"), F.stddev_pop("spread").alias("spread_std"))
    delta = F.coalesce(F.greatest(F.lit(0.0), (F.col("step") - F.col("tree_mean")) / (F.col("tree_std") + 1e-10)), F.lit(0.0))
    scored = resid.join(spread, "key").crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(usual))
    scored = stored(scored.select("key", "orthogonal_residual", delta.alias("mst_delta"), (F.abs(F.col("spread") - F.col("spread_mean")) / (F.col("spread_std") + 1e-10)).alias("knn_curvature")))
    names = ["orthogonal_residual", "mst_delta", "knn_curvature"]
    moments = scored.agg(*(f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [(F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-10) for c in names]
    out = stored(scored.crossJoin(F.broadcast(moments)).select("key", *names, F.array_sort(F.array(*z))[1].alias("deviation")))
    dropped(every, near, tree, scored)
    return out


def rotation_threshold(scores: DataFrame, score: str, key: str, quantile: float = 0.95, rotations: int = 200) -> float | None:
    """The quantile of the scores that `rotations` rotated copies of all rows would have.

    A rotation changes no distance, tangent or tree, so every copy has the scores of the rows themselves: the quantile
    is that of each score repeated, found by place. By the same argument no score is rarer than its own place says, and
    a false discovery rate under 1 on this null lets nothing through.
    """
    n = scores.count()
    if not n:
        return None
    at = quantile * (n * rotations - 1)
    low, high = math.floor(at) // rotations, math.ceil(at) // rotations
    ranked = placed(scores.select(F.col(score).alias("s"), F.col(key).alias("k")), [F.col("s"), F.col("k")])
    got = {r["place"]: r["s"] for r in ranked.filter(F.col("place").isin([low, high])).collect()}
    dropped(ranked)
    return got[low] + (got[high] - got[low]) * (at - math.floor(at))
