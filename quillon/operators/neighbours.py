"""Exact nearest neighbours of vectors, block by block, best first.

A tree of medians over a bounded sample deals the rows into cells, and large cells
are cut by key into blocks, so that many equal rows spread over tasks. Of every
block its box and its smallest key are known. A row visits the nearest boxes first,
few a round, and no box that is further than the k-th of the neighbours it has by
then; so rows are sent to few blocks, blocks stay where they are, and what a round
shuffles is bounded by the number of rows, however much the boxes overlap.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import dropped, stored

#: Rows of a block, and cells at most; the driver holds the boxes, and a sample of SAMPLE numbers to make them.
BLOCK, MOST_CELLS, SAMPLE = 500, 4096, 1 << 20
#: Blocks that a row visits in a round after the first (more if few rows still ask), rows that meet a block in one task,
#: and cuts of a large cell.
VISITS, GUESTS, CUTS = 8, 10_000, 1024
_ROW = "key long, cell int, block int, x array<double>"


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def lengths(gaps: np.ndarray) -> np.ndarray:
    """Of vectors along the last axis."""
    return np.sqrt((gaps**2).sum(-1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: the same number from both sides. Slices hold some 32 MB."""
    out, step = np.empty((len(a), len(b))), max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = lengths(a[i : i + step, None] - b[None])
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a product of matrices, and how far each may be from that of the differences."""
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    return size - 2 * (a @ b.T), size * (1e-14 * (a.shape[1] + 64))


class Splits:
    """A tree of medians, each along the widest side of its part of the sample; its leaves are the cells."""

    def __init__(self, x: np.ndarray, most: int):
        self.at, self.side, self.low, self.cell, self.cells = [], [], [], [], 0
        todo = [(x, most, -1)]
        while todo:
            part, leaves, above = todo.pop(0)
            node = len(self.at)
            self.at.append(0.0), self.side.append(-1), self.low.append(-1), self.cell.append(-1)
            if above >= 0 and self.low[above] < 0:
                self.low[above] = node
            spread = part.max(0) - part.min(0) if len(part) else np.zeros(0)
            side = int(spread.argmax()) if spread.size and np.isfinite(spread).all() else -1
            if leaves < 2 or side < 0 or not spread[side] > 0:
                self.cell[node], self.cells = self.cells, self.cells + 1
                continue
            v = np.sort(part[:, side])
            at = v[(len(v) - 1) // 2]
            self.at[node], self.side[node] = (at if at < v[-1] else v[v < at].max()), side
            less = part[:, side] <= self.at[node]
            todo += [(part[less], leaves - leaves // 2, node), (part[~less], leaves // 2, node)]
        self.at, self.side, self.low, self.cell = (np.array(v) for v in (self.at, self.side, self.low, self.cell))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while (inner := np.flatnonzero(self.side[node] >= 0)).size:
            on = node[inner]
            node[inner] = self.low[on] + ~(x[inner, self.side[on]] <= self.at[on])
        return self.cell[node]


class Cells:
    """Rows by cell and block: a stored table (key, cell, block, x), and the blocks' boxes, smallest keys and sizes."""

    def __init__(self, points: DataFrame, key: str, vector: str, k: int, pivots: int | None = None):
        x = stored(points.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x")).dropna())
        self.n, self.k = x.count(), k
        most = pivots or min(MOST_CELLS, max(1, self.n // BLOCK))
        wide = len((x.select("x").first() or {"x": [0.0]})["x"])
        some = x.orderBy(F.xxhash64("key"), "key").limit(max(most, min(32 * most, SAMPLE // max(1, wide)))).select("x").collect()
        sample = np.array([r["x"] for r in some]).reshape(len(some), wide)
        splits = Splits(sample[~np.isnan(sample).any(1)], most)

        def cell(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(splits(matrix(b.column(1))).astype(np.int32))], names=["key", "cell"])

        celled = x.mapInArrow(cell, "key long, cell int")
        size = np.zeros(splits.cells, int)
        for r in celled.groupBy("cell").count().collect():
            size[r["cell"]] = r["count"]
        parts, cuts = np.maximum(1, -(-size // BLOCK)), {}
        parts[size <= 2 * BLOCK] = 1
        if parts.max(initial=1) > 1:
            large = celled.filter(F.col("cell").isin(np.flatnonzero(parts > 1).tolist())).groupBy("cell")
            for r in large.agg(F.percentile_approx("key", [i / CUTS for i in range(1, CUTS)], 10_000).alias("q")).collect():
                m = parts[r["cell"]] = min(parts[r["cell"]], CUTS)
                cuts[r["cell"]] = np.array([r["q"][max(0, -(-i * CUTS // m) - 1)] for i in range(1, m)])
        first = np.concatenate([[0], np.cumsum(parts)])[:-1].astype(np.int64)

        self.deal = deal = Cells.dealing(splits, first, cuts)
        self.rows = stored(x.mapInArrow(deal, _ROW).repartition("block").sortWithinPartitions("block"))
        dropped(x)

        def boxes(batches):
            known = {}
            for b in batches:
                at, keys, v = b.column("block").to_numpy(), b.column("key").to_numpy(), matrix(b.column("x")) if b.num_rows else None
                for i in set(at.tolist()):
                    own = v[at == i]
                    own = own[~np.isnan(own).any(1)]  # a row without a place is no one's neighbour
                    got = (int((at == i).sum()), int(keys[at == i].min()), own.min(0, initial=np.inf), own.max(0, initial=-np.inf))
                    if i in known:
                        n, low, small, large = known[i]
                        got = (n + got[0], min(low, got[1]), np.minimum(small, got[2]), np.maximum(large, got[3]))
                    known[i] = got
            if known:
                yield pa.RecordBatch.from_pydict({"block": pa.array(list(known), pa.int32()), "n": pa.array([g[0] for g in known.values()]), "low": pa.array([g[1] for g in known.values()]), "small": pa.array([g[2].tolist() for g in known.values()], pa.list_(pa.float64())), "large": pa.array([g[3].tolist() for g in known.values()], pa.list_(pa.float64()))})

        blocks = int(parts.sum())
        self.size, self.low, self.cell = np.zeros(blocks, int), np.full(blocks, np.iinfo(np.int64).max), np.repeat(np.arange(splits.cells), parts)
        self.small, self.large = np.full((blocks, wide), np.inf), np.full((blocks, wide), -np.inf)
        for r in self.rows.mapInArrow(boxes, "block int, n long, low long, small array<double>, large array<double>").collect():
            i = r["block"]
            self.size[i], self.low[i] = self.size[i] + r["n"], min(self.low[i], r["low"])
            self.small[i], self.large[i] = np.minimum(self.small[i], r["small"]), np.maximum(self.large[i], r["large"])

    @staticmethod
    def dealing(splits: Splits, first: np.ndarray, cuts: dict[int, np.ndarray]):
        """From (key, x) to rows with cell and block."""

        def deal(batches):
            for b in batches:
                if b.num_rows:
                    at, keys = splits(matrix(b.column(1))), b.column(0).to_numpy()
                    block = first[at]
                    for c in set(at.tolist()) & set(cuts):
                        block[at == c] += np.searchsorted(cuts[c], keys[at == c])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(block.astype(np.int32)), b.column(1)], names=["key", "cell", "block", "x"])

        return deal

    def near(self) -> list[tuple[int, int]]:
        """Pairs of cells whose rows may be among each other's k nearest, by the cells' boxes alone."""
        live = sorted(set(self.cell[self.size > 0].tolist()))
        small, large = (np.array([f(v[self.cell == c], 0) for c in live]) for f, v in ((np.min, self.small), (np.max, self.large)))
        n, out = np.array([self.size[self.cell == c].sum() for c in live]), []
        for i, c in enumerate(live):
            far = lengths(np.maximum(large - small[i], large[i] - small))
            order = np.argsort(far)
            enough = np.searchsorted(np.cumsum(n[order]), self.k + 1)
            limit = far[order[enough]] if enough < len(order) else np.inf
            out += [(c, d) for d, gap in zip(live, lengths(np.maximum(0, np.maximum(small - large[i], small[i] - large))), strict=True) if gap <= limit]
        return out

    def visiting(self, asked: DataFrame, most: int, shut: np.ndarray | None = None) -> DataFrame:
        """asked (key, block, x, bound, worst, done, ...) with `to`, its next `most` blocks but for its own, `block`; rows
        that have none are left out.

        Blocks come by distance and smallest key. A block at the bound itself is of use only if a key is under `worst`.
        With shut, own blocks count too, blocks whose number there is the row's part hold nothing for it, and `core` is
        how close a row can be.
        """
        small, large, low = self.small, self.large, np.where(self.size > 0, self.low, np.iinfo(np.int64).max)

        def visit(batches):
            for b in batches:
                x, home, bound, worst, done = matrix(b.column("x")) if b.num_rows else None, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "bound", "worst", "done"))
                core, part = (b.column("core").to_numpy(), b.column("part").to_numpy()) if shut is not None else (None, None)
                order, to = np.argsort(home, kind="stable"), {}
                for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if b.num_rows else []:
                    # Blocks that none of these rows, which lie close together, can need.
                    reach = bound[at].max()
                    away = boxed(small, large, np.nanmin(x[at], 0)[None], np.nanmax(x[at], 0)[None])[0] if np.isfinite(x[at]).any(0).all() else np.zeros(len(small))
                    some = np.flatnonzero((away <= reach) & (low < np.iinfo(np.int64).max))
                    for s in range(0, len(at), 512):
                        rows = at[s : s + 512]
                        gap = boxed(small[some], large[some], x[rows], x[rows])
                        if shut is not None:
                            gap = np.maximum(gap, core[rows, None])
                        open_ = (gap < bound[rows, None]) | (gap == bound[rows, None]) & (low[some] < worst[rows, None])
                        open_ &= (shut[some] != part[rows, None]) if shut is not None else some != home[rows, None]
                        for i in np.flatnonzero(open_.sum(1) > done[rows]):
                            on = np.flatnonzero(open_[i])
                            to[rows[i]] = some[on[np.lexsort((on, low[some[on]], gap[i, on]))][done[rows[i]] : done[rows[i]] + most]].astype(np.int32)
                if to:
                    live = sorted(to)
                    yield from pa.Table.from_batches([b.take(pa.array(live))]).append_column("to", pa.array([to[i] for i in live], pa.list_(pa.int32()))).to_batches()

        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
        return stored(asked.mapInArrow(visit, f"{names}, to array<int>"))

    def meet(self, guests: DataFrame, rows: DataFrame, kernel, schema: str) -> DataFrame | None:
        """kernel(guest table, row table) on each block and the rows of visiting() that come to it; None if none do."""
        visits = guests.drop("block").withColumn("block", F.explode("to")).drop("to")
        parts = [(r["block"], -(-r["count"] // GUESTS)) for r in visits.groupBy("block").count().collect()]
        if not parts:
            return None
        known = rows.sparkSession.createDataFrame(parts, "block int, parts int")  # a row a block
        known, again = F.broadcast(known), F.broadcast(known.select(F.col("block"), F.col("parts")))
        left = visits.join(known, "block").withColumn("part_", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
        right = rows.select(*(F.col(c).alias(c) for c in rows.columns)).join(again, "block").withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return left.groupBy("block", "part_").cogroup(right.groupBy("block", "part_")).applyInArrow(kernel, schema)


def boxed(small: np.ndarray, large: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far boxes are at least from others (a row each): never more, by rounding, than a row in one is from one in the other."""
    out = np.zeros((len(low), len(small)))
    for i in range(small.shape[1]):
        gap = np.maximum(small[None, :, i] - high[:, i, None], low[:, i, None] - large[None, :, i])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return np.sqrt(out, out=out) * (1 - 1e-9)


def nearest(cells: Cells, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(key, neighbour, distance, rank): each row's k nearest other rows, ties to the smaller key. All of them where
    there are fewer. Keys must be unique; rows with a null key or vector have no neighbours and are none. Stored.

    With queries (key, x), of these the k nearest rows; a row of the same key counts.
    """
    names, schema, other = ["key", "neighbour", "distance"], "key long, neighbour long, distance double", queries is not None

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        got = []
        if q.num_rows and r.num_rows:
            rk, rx = r.column("key").to_numpy(), matrix(r.column("x"))
            qk, qx, bound = q.column("key").to_numpy(), matrix(q.column("x")), q.column("bound").to_numpy()
            step = max(1, 1_000_000 // len(rk))
            for s in range(0, len(qk), step):
                own, x = qk[s : s + step], qx[s : s + step]
                about, slack = estimates(x, rx)
                if not other:
                    about[own[:, None] == rk[None]] = np.inf
                limit = bound[s : s + step, None] ** 2 + slack
                if k < len(rk) and not np.isfinite(bound[s : s + step]).all():
                    limit = np.minimum(limit, np.partition(about + slack, k - 1, 1)[:, k - 1 : k] + slack)
                i, j = np.nonzero(np.isfinite(about) & (about <= limit + slack))
                d = lengths(x[i] - rx[j])
                order = np.lexsort((rk[j], d, i))
                i, j, d = i[order], j[order], d[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                live = (place < k) & (d <= bound[s : s + step][i])
                got.append((own[i[live]], rk[j[live]], d[live]))
        cols = [np.concatenate([g[c] for g in got]) if got else [] for c in range(3)]
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=names)

    rank = F.row_number().over(Window.partitionBy("key").orderBy("distance", "neighbour"))
    first = cells.rows if queries is None else queries.select("key", "x").dropna().mapInArrow(cells.deal, _ROW)
    start = [F.lit(float("inf")).alias("bound"), F.lit(np.iinfo(np.int64).max).cast("long").alias("worst")]
    state = stored(first.select("key", "block", "x", *start, F.lit(0).alias("done"), F.array("block").alias("to"), F.lit(True).alias("home")))
    found = None
    while (met := cells.meet(state.drop("home"), cells.rows, best, schema)) is not None:
        lists = stored((met if found is None else met.unionByName(found.select(*names))).withColumn("rank", rank).filter(F.col("rank") <= k))
        if found is not None:
            dropped(found)
        found = lists
        ends = found.filter(F.col("rank") == k).select("key", F.col("distance").alias("bound"), F.col("neighbour").alias("worst"))
        asked = state.select("key", "block", "x", F.when(F.col("home"), 0).otherwise(F.col("done") + F.size("to")).alias("done")).join(ends, "key", "left")
        asked = asked.select("key", "block", "x", F.coalesce("bound", start[0]).alias("bound"), F.coalesce("worst", start[1]).alias("worst"), "done", F.lit(False).alias("home"))
        after = cells.visiting(asked, VISITS * cells.n // max(1, min(cells.n, state.count())))
        dropped(state)
        state = after
    dropped(state)
    return found if found is not None else cells.rows.sparkSession.createDataFrame([], f"{schema}, rank int")


def closest_outside(cells: Cells, parts: DataFrame, picked: DataFrame, bounds: DataFrame) -> tuple[DataFrame, int]:
    """(part, w, a, b): the closest pairs with rows of other parts that lists of neighbours may have missed; and the
    largest part, which isn't asked.

    parts: (node, part); picked: (part, w), the closest listed pair of each part; bounds: (key, core, reach), where a
    pair that isn't listed is at `reach` or further. Closeness is the greatest of distance and both core distances.
    Only rows whose reach is under their part's w are asked, and only in boxes within w; what one row finds bounds the others.
    """
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.orderBy(F.desc("n"), "part").first() or {"n": 0, "part": -1}
    schema = "part long, w double, a long, b long"
    nothing = cells.rows.sparkSession.createDataFrame([], schema)
    if largest["n"] == cells.n:
        return nothing, largest["part"]
    known = stored(cells.rows.join(parts.withColumnRenamed("node", "key"), "key").join(bounds, "key"))
    most = picked.select("part", F.col("w").alias("bound"))
    asked = known.filter(F.col("part") != largest["part"]).join(most, "part", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).filter(F.col("reach") < F.col("bound"))
    shut = np.full(len(cells.size), np.iinfo(np.int64).min)  # a block of one part only
    for r in known.groupBy("block").agg(F.min("part").alias("part"), F.max("part").alias("last")).filter("part = last").collect():
        shut[r["block"]] = r["part"]
    names = ["key", "part", "core", "block", "x"]
    worst = F.lit(np.iinfo(np.int64).max).cast("long").alias("worst")

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        got = []
        if q.num_rows and r.num_rows:
            rx, (rp, rk, rc) = matrix(r.column("x")), (r.column(c).to_numpy() for c in ("part", "key", "core"))
            x, (p, k, c, bound) = matrix(q.column("x")), (q.column(n).to_numpy() for n in ("part", "key", "core", "bound"))
            step = max(1, 1_000_000 // len(rk))
            for s in range(0, len(k), step):
                at = slice(s, s + step)
                about, slack = estimates(x[at], rx)
                core = np.maximum(c[at, None], rc[None])
                about = np.where(p[at, None] == rp[None], np.inf, np.maximum(about, core**2))
                limit = np.minimum(bound[at, None] ** 2, (about + slack).min(1)[:, None]) + slack
                i, j = np.nonzero(np.isfinite(about) & (about <= limit + slack))
                w = np.maximum(lengths(x[at][i] - rx[j]), core[i, j])
                i, j, w = (v[w <= bound[at][i]] for v in (i, j, w))
                a, b, own = np.minimum(k[at][i], rk[j]), np.maximum(k[at][i], rk[j]), p[at][i]
                order = np.lexsort((b, a, w, own))  # the least pair of keys among equals, as everywhere
                order = order[np.unique(own[order], return_index=True)[1]]
                got.append((own[order], w[order], a[order], b[order]))
        cols = [np.concatenate([g[c] for g in got]) if got else [] for c in range(4)]
        return pa.table({n: pa.array(v, pa.float64() if n == "w" else pa.int64()) for n, v in zip(("part", "w", "a", "b"), cols, strict=True)})

    state, found = cells.visiting(asked.select(*names, "bound", worst, F.lit(0).alias("done")), 1, shut), None
    while (met := cells.meet(state, known.select(names), best, schema)) is not None:
        least = stored((met if found is None else met.unionByName(found)).groupBy("part").agg(F.min(F.struct("w", "a", "b")).alias("m")).select("part", "m.*"))
        if found is not None:
            dropped(found)
        found = least
        nearer = found.select("part", F.col("w").alias("nearer"))
        again = state.select(*names, "bound", "worst", (F.col("done") + F.size("to")).alias("done")).join(nearer, "part", "left")
        after = cells.visiting(again.select(*names, F.least("bound", "nearer").alias("bound"), "worst", "done"), VISITS * cells.n // max(1, state.count()), shut)
        dropped(state)
        state = after
    dropped(state, known)
    return nothing if found is None else found, largest["part"]
