"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens raised to an exponent. Exponent one
keeps the shares, zero makes all sources equal; bisection finds the exponent that
meets a target entropy or a repetition limit. The weights are realised as budgeted
block permutations: a source's documents are dealt to blocks, every pass permutes
the blocks and the documents in them, and the last pass stops at the token budget.
The sources may be any number: sums over them are taken in Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm._shared import fresh, materialise, release

WORD = r"[^\x20\x09-\x0D]+"


def weights(shares: list[float], exponent: float) -> list[float]:
    """Normalised shares ** exponent; a share of nothing keeps weight nothing."""
    top = max(shares, default=0) or 1.0
    raised = [(s / top) ** exponent if s > 0 else 0.0 for s in shares]
    return [r / (sum(raised) or 1.0) for r in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repeats(tokens: list[int], w: list[float], budget: float | None) -> list[float]:
    """Passes over each source. Without a budget, the least repeated source is passed once."""
    rate = [x / t if t else 0.0 for x, t in zip(w, tokens, strict=True)]
    scale = budget if budget is not None else 1 / min((r for r in rate if r > 0), default=1.0)
    return [r * scale for r in rate]


class Moments:
    """What bisection asks about the sources, whose shares are taken relative to the largest.

    sums(exponents): the sums of share ** e and of share ** e * log(share). least: the
    smallest share that isn't nothing. top: the tokens of the largest source.
    """

    def __init__(self, sums, least: float, top: float):
        self.sums, self.least, self.top = sums, least, top

    def entropies(self, exponents: np.ndarray) -> np.ndarray:
        raised, logs = self.sums(exponents)
        return np.log(raised) - exponents * logs / raised

    def most_repeats(self, exponents: np.ndarray, budget: float | None) -> np.ndarray:
        """Passes of the smallest source, which is repeated most. Without a budget the largest is passed once."""
        rate = self.least ** (exponents - 1)
        return rate if budget is None else rate / self.sums(exponents)[0] * budget / self.top


def moments_of(tokens: list[int]) -> Moments:
    """Of a list of token sums, in memory."""
    t = np.array([x for x in tokens if x > 0] or [1], float)
    r = t / t.max()

    def sums(e):
        raised = r[None] ** e[:, None]
        return raised.sum(1), (raised * np.log(r)[None]).sum(1)

    return Moments(sums, float(r.min()), float(t.max()))


def find_exponent(found: Moments | list[int], target_entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None, ways: int = 64, rounds: int = 9) -> float:
    """The exponent in 0..1 that meets the target entropy, or the smallest under the repetition limit.

    Both change in one direction with the exponent. Each round cuts the interval in
    `ways` at once, so that nine rounds of 64 are as fine as 54 halvings. A target out
    of reach gives the nearest end.
    """
    found = found if isinstance(found, Moments) else moments_of(found)
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = np.linspace(low, high, ways + 1)
        if target_entropy is not None:
            flat = found.entropies(grid) > target_entropy
        else:
            flat = found.most_repeats(grid, budget) > (most_repeats if most_repeats is not None else math.inf)
        if not flat[0] or flat[-1]:
            return low if not flat[0] else high
        k = int(np.argmin(flat))
        low, high = float(grid[k - 1]), float(grid[k])
    return high


def _moments_in_spark(stats: DataFrame, least: int, top: int) -> Moments:
    """Of a table of sources with their tokens t."""
    shares = stats.filter("t > 0").select((F.col("t") / F.lit(float(top))).alias("share"))

    def sums(exponents):
        e = np.array(exponents, float)

        def partial(batches):
            raised, logs = np.zeros(len(e)), np.zeros(len(e))
            for batch in batches:
                r = batch.column(0).to_numpy()
                for i in range(0, len(r), 10_000):
                    x = r[i : i + 10_000, None] ** e[None]
                    raised += x.sum(0)
                    logs += (x * np.log(r[i : i + 10_000, None])).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(raised), pa.array(logs), pa.array(range(len(e)), pa.int64())], names=["raised", "logs", "k"])

        got = shares.mapInArrow(partial, "raised double, logs double, k long").groupBy("k").agg(F.sum("raised"), F.sum("logs")).orderBy("k").collect()  # a row an exponent
        return np.array([g[1] for g in got]), np.array([g[2] for g in got])

    return Moments(sums, least / top, float(top))


def mix_sources(
    docs: DataFrame, target_entropy: float | None = None, most_repeats: float | None = 2.0, budget: int | None = None, seed: int = 17, block_docs: int = 1000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """(docs' columns with each document once a pass it is in; names of the added columns).

    Added: pass (from 0), block, tokens (words unless given), weight (of the source),
    and turn and place: a pass is read in the order of turn, block, place and id, which
    permutes the blocks of all sources and the documents in each block.

    With no budget every document is in at least one pass, and sources below the
    largest share are repeated up to most_repeats times; with one, a source's quota
    is weight * budget tokens, which its last pass never exceeds. A target_entropy
    takes the place of the repetition limit.

    Null sources are one source. A source without tokens is passed once. Null and
    empty texts have no tokens; ids may be null or repeat: rows that tie in id and
    tokens are interchangeable; an empty table gives an empty result. docs' columns may
    have any names: an added name that is taken gets underscores. Texts, however long,
    stay in Spark's rows.
    """
    names = {k: fresh(docs.columns, f"mix_{k}") for k in ("pass", "block", "tokens", "weight", "turn", "place")}
    words = tokens if tokens is not None else F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    # All of docs' columns travel as one, so that none can clash with ours.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).cast("string").alias("s"), F.col(id_col).cast("string").alias("id"), words.cast("long").alias("n"))
    # What is decided before the result is decided on rows without texts; whole rows are read once more, where they are.
    thin = materialise(own.select("s", "id", "n"))
    stats = materialise(thin.groupBy("s").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c")))
    top, least = stats.filter("t > 0").agg(F.max("t"), F.min("t")).first()
    exponent, raised = 1.0, 1.0
    if top:
        found = _moments_in_spark(stats, least, top)
        exponent = find_exponent(found, target_entropy, most_repeats, budget)
        raised = float(found.sums([exponent])[0][0])
    # weight: share ** exponent, normalised. Passes: weight / tokens * scale, as repeats() has it.
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(top or 1)), F.lit(exponent)) / F.lit(raised)).otherwise(0.0)
    scale = float(budget) if budget is not None else raised * (top or 1)
    quotas = stats.withColumn("weight", weight).withColumn("quota", F.floor(F.col("weight") * F.lit(scale) + 0.5).cast("long")).select(
        F.col("s").alias("q"), "weight", F.when(F.col("t") > 0, F.floor(F.col("quota") / F.col("t"))).otherwise(1).cast("long").alias("full"),
        F.when(F.col("t") > 0, F.col("quota") % F.col("t")).otherwise(0).cast("long").alias("rest"), F.ceil(F.col("c") / block_docs).cast("long").alias("blocks"),
    )
    key = F.xxhash64("id", F.lit(seed))
    turn_of = lambda of_pass: F.xxhash64("block", F.lit(seed), of_pass)
    place_of = lambda of_pass: F.xxhash64(key, of_pass)
    block_of = F.pmod(F.xxhash64(key, F.lit(1)), F.col("blocks"))
    dealt = thin.join(quotas, F.col("s").eqNullSafe(F.col("q"))).withColumn("block", block_of)
    # Tokens before each block in the last pass's permutation of its source's blocks: by ranges of turns, then within each.
    sized = dealt.groupBy("q", "block", "full", "rest").agg(F.sum("n").alias("t")).withColumn("turn", turn_of(F.col("full"))).withColumn("range", F.shiftright("turn", 54))
    far, near = Window.partitionBy("r_q").orderBy("r_range"), Window.partitionBy("q", "range").orderBy("turn", "block")
    ranges = sized.groupBy(F.col("q").alias("r_q"), F.col("range").alias("r_range")).agg(F.sum("t").alias("r_t")).withColumn("earlier", F.sum("r_t").over(far) - F.col("r_t"))
    ordered = sized.withColumn("here", F.sum("t").over(near) - F.col("t"))
    before = ordered.join(ranges, F.col("q").eqNullSafe(F.col("r_q")) & (F.col("range") == F.col("r_range"))).withColumn("before", F.col("earlier") + F.col("here"))
    # The last pass ends in one block of a source: blocks with earlier turns are in it, those with later turns aren't.
    end = materialise(before.filter("rest > 0 and before <= rest and rest < before + t").select(F.col("q").alias("e_q"), F.col("turn").alias("e_turn"), F.col("block").alias("e_block"), "before"))
    order_key = F.struct(place_of(F.col("full")).alias("place"), "id", "n")
    inside = Window.partitionBy("q").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ending = dealt.join(end, F.col("q").eqNullSafe(F.col("e_q")) & (F.col("block") == F.col("e_block"))).withColumn("key", order_key)
    fitting = ending.withColumn("fits", (F.col("before") + F.sum("n").over(inside) <= F.col("rest")).cast("long"))
    # The last key that fits; of the `tied` rows that have it, `fit` fit.
    keys = fitting.groupBy("q", "key").agg(F.sum("fits").alias("fit"), F.count(F.lit(1)).alias("tied")).filter("fit > 0")
    last = keys.groupBy(F.col("q").alias("l_q")).agg(F.max_by(F.struct("key", "fit", "tied"), "key").alias("last"))
    plan = quotas.join(end, F.col("q").eqNullSafe(F.col("e_q")), "left").join(last, F.col("q").eqNullSafe(F.col("l_q")), "left")
    plan = materialise(plan.select("q", "weight", "full", "rest", "blocks", "e_turn", "e_block", "last"))
    release(thin, stats, end)
    placed = own.join(plan, F.col("s").eqNullSafe(F.col("q"))).withColumn("block", block_of).withColumn("turn", turn_of(F.col("full")))
    same_block = (F.col("turn") == F.col("e_turn")) & (F.col("block") == F.col("e_block"))
    earlier = (F.col("turn") < F.col("e_turn")) | (F.col("turn") == F.col("e_turn")) & (F.col("block") < F.col("e_block"))
    no = F.lit(False)
    passes = placed.withColumn("passes", F.col("full") + F.coalesce(earlier | same_block & (order_key <= F.col("last.key")), no).cast("long"))
    if not plan.filter("last.tied > last.fit").isEmpty():
        torn = F.coalesce(same_block & (order_key == F.col("last.key")) & (F.col("last.tied") > F.col("last.fit")), no)
        nth = F.row_number().over(Window.partitionBy("q").orderBy("id"))
        some = passes.filter(torn).withColumn("passes", F.col("full") + (nth <= F.col("last.fit")).cast("long"))
        passes = passes.filter(~torn).unionByName(some)
    passes = passes.filter("passes > 0")
    out = passes.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))).withColumn("turn", turn_of(F.col("pass"))).withColumn("place", place_of(F.col("pass")))
    added = {"pass": "pass", "block": "block", "tokens": "n", "weight": "weight", "turn": "turn", "place": "place"}
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *(F.col(c).alias(names[k]) for k, c in added.items())), names


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """A row for each document and pass: doc_id, source, n_tokens, pass, block, turn, place, weight. As mix_sources(), which it calls."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    text_col = options.get("text_col", "text")
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    mixed, names = mix_sources(thin, tokens=F.col("n_tokens"), **{k: v for k, v in options.items() if k not in ("id_col", "source_col", "text_col")})
    return mixed.select("doc_id", "source", "n_tokens", *(F.col(names[k]).alias(k) for k in ("pass", "block", "turn", "place")), F.round(names["weight"], 9).alias("weight"))
