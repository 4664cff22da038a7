"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles, reduced to minwise tokens. In each of
several independent trees the root and every node choose a few token positions,
and a document descends to the child named by its token at each chosen position,
so that similar documents meet in some node with a probability that grows with
their similarity (Christiani, Pagh and Sivertsen 2018). Small nodes are compared
exhaustively: token agreement first, then, on the full sets, the exact
similarity. A node returns a spanning forest of its links, never all pairs.

Documents with equal sets are one entry throughout. A node still large after the
last level is dealt to slices. First each slice is compared within itself and with a
few pivots, which finds the large groups of near copies; then all pairs of slices are
compared, except pairs of documents that are connected already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _hashing as H
from quillon.llm._components import components
from quillon.llm._shared import bounded_batches, materialise

TOKENS = 128
#: Documents that a node compares exhaustively; its matrices take about 100 MB.
NODE = 4096
SLICE, PIVOTS = 2048, 32
BUCKET_ROWS = 8192
#: Bytes of full sets in a slice that is confirmed at once.
CONFIRM = 32 << 20
FEW = 1_000_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as 64-bit fingerprints, sorted within each text, and n + 1 pointers."""
    low = H.lower_ascii(buf)
    starts, ends, ptr = H.word_spans(low, offs)
    which, values = H.distinct_ranges(low, starts, ends)
    word = H.digests(values)[0][which]
    at, doc = H.windows(ptr, k)
    size = np.diff(ptr)
    short = np.flatnonzero((size > 0) & (size < k))
    whole = np.zeros(len(short), np.uint64)  # a text of fewer than k words: all of them, in order, and their number
    for i in range(k - 1):
        more = size[short] > i
        whole[more] = H.combine(whole[more], word[ptr[short[more]] + i])
    h = np.concatenate([H.runs_of(word, k)[at], H.combine(whole, size[short].astype(np.uint64))])
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offs)))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _linked(inter: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs reach the similarity, from the sizes of all intersections and sets."""
    out = np.empty(inter.shape, bool)
    for i in range(len(size)):
        both = inter[i].astype(np.int64)
        out[i] = 100 * both >= percent * (size[i] + size - both)
    return out


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n items of a boolean n x n matrix."""
    n = len(adjacent)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i], front = i, np.array([i])
        while len(front):
            reach = adjacent[front].any(0) & (label < 0)
            front = np.flatnonzero(reach)
            label[front] = i
    return label


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    values, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.bincount(col, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], place[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total, width, tall = np.zeros((n, n), np.float32), 1024, 512
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [c, c + width])
        x = np.zeros((n, width), np.float32)
        x[row[a:b], col[a:b] - c] = 1
        for i in range(0, n, tall):
            total[i : i + tall] += x[i : i + tall] @ x.T
    return total


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cut.tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(values) else []


def near_groups(docs: DataFrame, percent: int = 75, shingle: int = 5, trees: int = 6, chosen: int = 2, levels: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Sets hold the distinct shingles of lower-cased (A-Z) words; a text with fewer
    words is one shingle; one without words is empty and linked with nothing.
    Documents are linked from percent % Jaccard similarity on, confirmed on full
    sets; component_id is the smallest id reachable. With trees * chosen root
    positions, a pair at the threshold meets in no node with a probability of
    (1 - percent / 100) ** (trees * chosen), 6e-8 by default; where all its nodes
    branch, each level loses some of them, and it is 1e-6 after two levels. All pairs
    of a node are compared, whatever its size.

    Rows without an id are linked with nothing and kept. Rows with equal ids are one
    document; should their texts differ, the smallest is compared. Pairs exactly at the
    threshold are linked. An empty table gives an empty result; other columns, whatever
    their names, are ignored. A text is held whole by one task, with about 30 times its
    size, and two slices of full sets of CONFIRM bytes (or one longer set) each.
    """
    n_keys, slack = trees * chosen, 5 * np.sqrt(TOKENS * percent / 100 * (1 - percent / 100))
    least_equal = int(TOKENS * percent / 100 - slack)
    multipliers = _multipliers(TOKENS)
    read = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                h, ptr = shingle_sets(*H.text_buffer(part.column(1)), shingle)
                n = np.diff(ptr)
                full = np.flatnonzero(n)
                tokens = np.zeros((len(n), TOKENS), np.uint32)
                sums = np.zeros((len(n), 2), np.uint64)
                if len(full):
                    for i, m in enumerate(multipliers):
                        tokens[full, i] = np.minimum.reduceat((h * m) >> np.uint64(32), ptr[full]).astype(np.uint32)
                    for i in (0, 1):
                        sums[full, i] = np.add.reduceat(H.mix(h ^ multipliers[i]), ptr[full])
                keys = H.mix(tokens[:, :n_keys].astype(np.uint64) + (np.arange(n_keys, dtype=np.uint64) << np.uint64(40))).astype(np.int64)
                low = (tokens & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([s.tobytes() for s in sums], pa.binary()), pa.array([s.tobytes() for s in low], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "tokens", "keys"],
                )

    sketched = materialise(read.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, tokens binary, keys array<long>"))
    one = sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key", "n_shingles")
    sets = materialise(one.agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("keys").alias("keys")))

    def crowded(rows: DataFrame, branching: bool = False) -> DataFrame:
        """Members of nodes with two or more; of nodes with the same members, one, unless they branch (each chooses other positions)."""
        own = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
        alone = F.when(F.lit(branching) & (F.col("size") > NODE), F.col("node"))
        first = own.filter("size > 1").groupBy("size", "x", "s", alone.alias("alone")).agg(F.min("node").alias("node"))
        return rows.join(first.select("node", "size"), "node")

    rows = sets.select("rep", F.explode("keys").alias("node"))
    tasks = []
    tokens = sets.select("rep", "tokens")
    for level in range(levels + 1):
        member = materialise(crowded(rows, level < levels))
        tasks.append(member.filter(F.col("size") <= NODE).select(F.col("node").alias("task"), "rep"))
        large = member.filter(F.col("size") > NODE)
        if level == levels or large.isEmpty():
            break
        known = large.join(tokens, "rep")
        child = [F.xxhash64("node", F.lit(i), F.substring("tokens", F.pmod(F.xxhash64("node", F.lit(i)), F.lit(TOKENS)).cast("int") + 1, F.lit(1))) for i in range(chosen)]
        rows = known.select("rep", F.explode(F.array_distinct(F.array(*child))).alias("node"))
    sliced = not large.isEmpty()
    if sliced:
        slices = F.ceil(F.col("size") / SLICE).cast("long")
        place = F.xxhash64("rep", "node")
        tasks.append(large.select(F.xxhash64("node", F.pmod(place, slices)).alias("task"), "rep"))
        pivot = large.groupBy("node", "size", F.pmod(F.shiftright(place, 7), F.lit(PIVOTS)).alias("k")).agg(F.min_by("rep", place).alias("rep"))
        tasks.append(pivot.select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("s")).select(F.xxhash64("node", "s").alias("task"), "rep"))
    asked = tasks[0]
    for t in tasks[1:]:
        asked = asked.unionAll(t)
    def compare_tokens(table):
        """(group, rep) of documents that resemble another of their task that is of another part, grouped by resemblance."""
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        task, rep, size, part = (table.column(c).to_numpy()[order] for c in ("task", "rep", "n_shingles", "part"))
        raw = table.column("tokens").to_pylist()
        sig = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).reshape(-1, TOKENS)
        groups, reps = [], []
        for a, b in _runs(task):
            s, n, p = sig[a:b], size[a:b], part[a:b]
            if b - a == 2:
                close = p[0] != p[1] and (s[0] == s[1]).sum() >= least_equal and 100 * n.min() >= percent * n.max()
                alike = np.array([[False, close], [close, False]])
            else:
                alike = np.empty((b - a, b - a), bool)
                for i in range(0, b - a, 512):
                    same = np.zeros((len(s[i : i + 512]), b - a), np.uint8)
                    for t in range(TOKENS):
                        same += s[i : i + 512, t, None] == s[None, :, t]
                    m = n[i : i + 512, None]
                    alike[i : i + 512] = (same >= least_equal) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (p[i : i + 512, None] != p)
            np.fill_diagonal(alike, False)
            found = np.flatnonzero(alike.any(1))
            if len(found):
                label = _labels(alike[np.ix_(found, found)])
                groups.append(H.mix(task[a:b][:1].astype(np.uint64) + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64))
                reps.append(rep[a:b][found])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"node": pa.array(cat(groups), pa.int64()), "rep": pa.array(cat(reps), pa.int64())})

    def full_sets(batches):
        for batch in batches:
            h, ptr = shingle_sets(*H.text_buffer(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())], names=["rep", "shingles"])

    def confirm(table):
        """A spanning forest of each group's links, by exact similarity of the full sets."""
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        node, rep = (table.column(c).to_numpy()[order] for c in ("node", "rep"))
        raw = table.column("shingles").to_pylist()
        low, high = [], []
        for a, b in _runs(node):
            sets_ = [np.frombuffer(raw[order[i]], np.uint64) for i in range(a, b)]
            n = np.array([len(s) for s in sets_])
            if b - a == 2:
                inter = len(np.intersect1d(sets_[0], sets_[1], assume_unique=True))
                label = np.array([0, 0 if 100 * inter >= percent * (n.sum() - inter) else 1])
            else:
                label = _labels(_linked(_intersections(sets_), n, percent))
            moved = label != np.arange(b - a)
            low.append(rep[a:b][label[moved]])
            high.append(rep[a:b][moved])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(low), pa.int64()), "b": pa.array(cat(high), pa.int64())})

    def links(asked: DataFrame) -> DataFrame:
        """(a, b): links between documents of one task and of different parts, from (task, rep, part)."""
        asked = materialise(asked)
        n_buckets = max(1, -(-asked.count() // BUCKET_ROWS))
        deal = lambda c: F.pmod(F.xxhash64(c), F.lit(n_buckets)).cast("int")
        alike = asked.join(sets.select("rep", "n_shingles", "tokens"), "rep").withColumn("bucket", deal("task"))
        groups = materialise(crowded(alike.groupBy("bucket").applyInArrow(compare_tokens, "node long, rep long")).drop("size"))
        # A task confirms at most two slices of a group, of about CONFIRM bytes of sets each; all pairs of slices are tasks.
        weighed = groups.join(sets.select("rep", "n_shingles"), "rep")
        slices = materialise(weighed.groupBy("node").agg(F.ceil(F.sum("n_shingles") * 8 / CONFIRM).cast("long").alias("slices")).filter("slices > 1"))
        own = F.pmod(F.xxhash64("rep", "node"), F.col("slices"))
        dealt = weighed.join(slices, "node", "left").fillna(1, ["slices"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        dealt = materialise(dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "n_shingles"))
        weight = dealt.agg(F.sum("n_shingles")).first()[0] or 0
        n_confirm = max(1, -(-weight * 8 // CONFIRM))
        wanted = dealt.select("rep").distinct()
        if wanted.count() <= FEW:  # at most 16 MB: texts are filtered where they are read; beyond, both sides are shuffled
            wanted = F.broadcast(wanted)
        texts = read.join(wanted, read["doc_id"] == wanted["rep"], "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        held = dealt.select("node", "rep").join(texts.mapInArrow(full_sets, "rep long, shingles binary"), "rep").withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(n_confirm)))
        return materialise(held.groupBy("bucket").applyInArrow(confirm, "a long, b long"))

    def slice_pairs(linked: DataFrame) -> DataFrame:
        """(task, rep, part): each pair of a large node's slices. Large components have slices of their own, which aren't paired with each other."""
        parted = large.select("node", "rep").join(linked, "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("part"))
        sized = materialise(parted.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n")))
        big = sized.filter(F.col("n") > SLICE).withColumn("own", F.col("part"))
        pool = sized.filter(F.col("n") <= SLICE).groupBy("node").agg(F.sum("n").alias("n"))
        slices = F.ceil(F.col("n") / SLICE).cast("long")
        numbered = F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("k")
        key = F.xxhash64("node", "own", "k")
        every = materialise(big.select("node", "own", numbered).unionByName(pool.select("node", F.lit(None).cast("long").alias("own"), numbered)).select("node", "own", key.alias("slice")))
        other = every.select("node", F.col("own").alias("own2"), F.col("slice").alias("slice2"))
        known = F.coalesce(F.col("own") == F.col("own2"), F.lit(False))
        pairs = every.join(other, "node").filter((F.col("slice") <= F.col("slice2")) & ~known)
        asked = pairs.select(F.xxhash64("node", "slice", "slice2").alias("task"), F.explode(F.array_distinct(F.array("slice", "slice2"))).alias("slice"))
        # a row for each SLICE members at most, so that these sides are small
        placed = parted.join(F.broadcast(big.withColumnRenamed("n", "n_own")), ["node", "part"], "left").join(F.broadcast(pool), "node", "left").withColumn("n", F.coalesce("n_own", "n"))
        placed = placed.withColumn("k", F.pmod(F.xxhash64("rep", "node"), slices)).select(key.alias("slice"), "rep", "part")
        return placed.join(asked, "slice").select("task", "rep", "part")

    found = links(asked.distinct().withColumn("part", F.col("rep")))
    if sliced:
        linked = materialise(components(found))
        found = linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links(slice_pairs(linked.toDF("rep", "component"))))
    linked = components(found).withColumnRenamed("node", "rep")
    of_set = sets.select("set_key", "n_shingles", "rep").join(linked, "rep", "left").select("set_key", "n_shingles", F.coalesce("component", "rep").alias("of_set"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(of_set, ["set_key", "n_shingles"], "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("of_set", "doc_id"))
    return out.withColumn("component_id", found).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group of near_groups() the document with the smallest id, with all its columns, whatever their names.

    Rows without an id are all kept. Of rows with an equal id one is kept, that with the smallest text. An empty
    table gives an empty result.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col, **options).filter("doc_id is not null").groupBy("doc_id")
    # Ids that go (no row is kept), and those of several rows that are kept. They are few, so that rows can stay where they are.
    other = materialise(groups.agg(F.sum(F.col("kept").cast("long")).alias("times")).filter("times <> 1"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("k"))
    named = own.filter("k is not null")
    rows = own.filter("k is null").select("row").unionByName(named.join(other.select("doc_id"), F.col("k") == F.col("doc_id"), "left_anti").select("row"))
    repeated = other.filter("times > 1").select("doc_id")
    if not repeated.isEmpty():
        text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
        rows = rows.unionByName(named.join(repeated, F.col("k") == F.col("doc_id"), "left_semi").groupBy("k").agg(F.min_by("row", text).alias("row")).select("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
