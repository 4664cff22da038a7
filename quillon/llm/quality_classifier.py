"""A generalised additive quality model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time and then one pair at a
time, on binned features. Their sum is a lookup table a feature and a pair, so a
document's score is a few table entries added up, for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _hashing as H
from quillon.llm.lm_scoring import crc_bucket
from quillon.llm.quality_rules import features as measures
from quillon.llm._shared import bounded_batches, materialise

FEATURES = ["log_words", "word_length", "symbols", "upper", "digits", "repeated_words", "repeated_lines", "distinct_words", "adjacent_words", "sentence_ends", "bars", "line_words"]
OUT = "doc_id long, held_out boolean, score double, predicted int"


def text_features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n x len(FEATURES); from the text alone."""
    m = measures(buf, offs)
    words, lines, letters = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1), np.maximum(m["n_letters"], 1)
    cols = [
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_upper"] / letters, m["n_digits"] / words, m["n_repeat_words"] / words, m["n_dup_lines"] / lines,
        m["n_distinct_words"] / np.sqrt(words), m["n_adjacent"] / words, m["n_ends"] / words, m["n_bars"] / words, np.log1p(words / lines),
    ]
    return np.stack([np.asarray(c, float) for c in cols], 1)


@dataclass
class AdditiveModel:
    """intercept + a table a feature + a table a pair, on the log-odds scale."""

    edges: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for f, t in enumerate(self.tables):
            out += t[bins[:, f]]
        for (i, j), t in self.pairs.items():
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.bins(x)), -40, 40)))


def _stump_tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A tree of at most `leaves` leaves over ordered bins with gradient sums g and hessian sums h: its value in each bin."""
    gain = lambda a, b: a * a / (b + l2)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                left = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
                k = int(left.argmax())
                if left[k] > best[0]:
                    best = (left[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _cross_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Over a grid of two features' bins: the best cut of each into four cells. Its gain and its value in each cell."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    best, value = 0.0, np.zeros_like(g)
    for r in range(1, g.shape[0]):
        parts = []
        for c in (cg, ch):
            a, b = c[r, 1:-1], c[-1, 1:-1] - c[r, 1:-1]
            parts.append((a, c[r, -1] - a, b, c[-1, -1] - c[r, -1] - b))
        total = sum(x * x / (y + l2) for x, y in zip(*parts, strict=True)) if g.shape[1] > 1 else np.zeros(0)
        if len(total) and total.max() > best:
            k = int(total.argmax())
            best = float(total[k])
            v = [x[k] / (y[k] + l2) for x, y in zip(*parts, strict=True)]
            value = np.empty_like(g)
            value[:r, : k + 1], value[:r, k + 1 :], value[r:, : k + 1], value[r:, k + 1 :] = v
    return best, value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, leaves: int = 3, pairs: int = 6, pair_rounds: int = 40, l2: float = 2.0) -> AdditiveModel:
    """Boost main effects, then the pairs that explain most of what they leave."""
    model = AdditiveModel()
    if not len(y):
        return model
    rate_good = np.clip(y.mean(), 0.01, 0.99)
    model.intercept = float(np.log(rate_good / (1 - rate_good)))
    for f in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
    b = model.bins(x)
    z = model.log_odds(b)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _stump_tree(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)), leaves, l2)
            t += step
            z += step[b[:, f]]

    def grid(i, j):
        shape = len(model.tables[i]), len(model.tables[j])
        at = b[:, i] * shape[1] + b[:, j]
        g, h = slopes()
        return _cross_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape), l2)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-grid(*p)[0], p))[:pairs]
    model.pairs = {p: np.zeros((len(model.tables[p[0]]), len(model.tables[p[1]]))) for p in ranked}
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            step = rate * grid(i, j)[1]
            t += step
            z += step[b[:, i], b[:, j]]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out_fold: int = 2, sample: int = 20_000, good_from: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score all whole texts from 0 to 1; learn from labelled documents outside one fold.

    The model is fitted on at most `sample` labelled rows, those of the smallest
    hashes; all rows are scored. Inputs of a score come from the text alone. A null or
    empty text gets the score of empty texts; a null id has no label; repeated rows, of
    documents or of labels, teach once and are scored alike, and a document with both
    labels teaches both; without labels every score is a half. An empty table gives an
    empty result; other columns, whatever their names, are ignored. A text is held
    whole by one task, with about 30 times its size.
    """
    names = [f"f{i}" for i in range(len(FEATURES))]

    def extract(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = text_features(*H.text_buffer(part.column(1)))
                held = crc_bucket(part.column(0).to_pylist(), folds) == held_out_fold
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", "held_out", *names])

    read = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = materialise(read.mapInArrow(extract, "doc_id long, held_out boolean, " + ", ".join(f"{n} double" for n in names)))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().distinct()
    taught = materialise(known.filter("not held_out").join(marks, "doc_id").dropDuplicates(["doc_id", "y", *names]).withColumn("turn", F.xxhash64("doc_id", "y", *names)))
    # The rows of the smallest hashes: a cut that leaves about twice as many, and only those are sorted and sent.
    n, drawn = taught.count(), taught
    if n > 2 * sample:
        drawn = taught.filter(F.col("turn") < F.lit(-(1 << 63) + (1 << 64) * 2 * sample // n))
        drawn = drawn if drawn.count() >= sample else taught
    train = drawn.orderBy("turn", "doc_id", "y", *names).limit(sample).select("y", *names).toPandas()
    model = fit(train[names].to_numpy(float), train["y"].to_numpy(float))

    def apply(batches):
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy() for n in names], 1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= good_from).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return known.mapInArrow(apply, OUT)
