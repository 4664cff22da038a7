"""Quality rules as weak supervision.

Each rule votes good or bad or abstains. Expectation-maximisation estimates how
each rule votes on good and on bad documents, from the counts of vote patterns
over all documents (at most 3**rules of them), and a document's posterior
probability of being good replaces the demand that every rule pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import _hashing as H
from quillon.llm._shared import bounded_batches, materialise

_LONGS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words", "n_ends", "n_bars"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0], np.cumsum(mask)])
    return cum[offs[1:]] - cum[offs[:-1]]


def adjacent_repeats(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word equals the one before it in its document."""
    out = np.zeros(len(word), bool)
    out[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    return out


def _repeats(*items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of these columns equal another; which equal an earlier one. Rows are sorted by a hash and then compared in full."""
    key = np.zeros(len(items[0]), np.uint64)
    for c in items:
        key = H.combine(key, c.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    if len(key):
        same[1:-1] = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in items])
    twice, later = np.empty(len(key), bool), np.empty(len(key), bool)
    twice[order], later[order] = same[:-1] | same[1:], same[:-1]
    return twice, later


def features(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of the rules for each text."""
    starts, ends, ptr = H.word_spans(buf, offs)
    n = len(offs) - 1
    lead = (buf & 0xC0) != 0x80
    word, _ = H.distinct_ranges(buf, starts, ends)
    at, doc = H.windows(ptr, 3)
    twice, _ = _repeats(doc, word[at], word[at + 1], word[at + 2])
    edge = np.zeros(len(starts) + 3, np.int64)
    np.add.at(edge, at[twice], 1)
    np.subtract.at(edge, at[twice] + 3, 1)
    covered = np.cumsum(edge)[: len(starts)] > 0
    word_doc = np.repeat(np.arange(n), np.diff(ptr))
    _, later_word = _repeats(word_doc, word)
    # Lines: cut at \n and at the texts' ends.
    newline = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([offs[:-1], newline + 1]))
    begin = begin[begin < len(buf)]
    stop = np.minimum(np.append(begin[1:], len(buf)), len(buf))
    stop = stop - ((stop > begin) & (buf[stop - 1] == 10)) if len(begin) else stop
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(offs, begin, side="right") - 1
    _, later_line = _repeats(line_doc, H.distinct_ranges(buf, begin, stop)[0])
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    last = np.isin(buf[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    at_text = lambda mask: _per_text(mask, ptr)
    return {
        "n_words": np.diff(ptr), "word_chars": _per_text(lead & ~H.SPACE[buf], offs), "n_symbols": _per_text(_SYMBOL[buf], offs),
        "n_dup_lines": np.bincount(line_doc[later_line], minlength=n), "n_repeat_words": at_text(covered), "n_lines": np.bincount(line_doc, minlength=n),
        "n_upper": _per_text(upper, offs), "n_letters": _per_text(upper | lower, offs), "n_distinct_words": at_text(~later_word), "n_ends": at_text(last),
        "n_adjacent": at_text(adjacent_repeats(word, word_doc)), "n_digits": _per_text((buf >= 48) & (buf <= 57), offs),
        "n_bars": at_text((ends - starts == 1) & (buf[starts] == ord("|"))) if len(starts) else np.zeros(n, np.int64),
    }


def rules() -> dict[str, tuple[Column, Column]]:
    """(votes good, votes bad) of each rule; it abstains when neither holds."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    per = lambda x: c(x) / words
    upper = c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    length = c("word_chars") / words
    lines = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    return {
        "symbols": (per("n_symbols") < 0.05, per("n_symbols") > 0.4),
        "upper_case": (upper < 0.15, upper > 0.4),
        "repeated_words": (per("n_repeat_words") < 0.1, per("n_repeat_words") > 0.4),
        "repeated_lines": (lines < 0.1, lines > 0.4),
        "distinct_words": ((c("n_words") >= 50) & (per("n_distinct_words") > 0.3), (c("n_words") >= 20) & (per("n_distinct_words") < 0.15)),
        "word_length": (length.between(3, 9), ~length.between(2, 14)),
        "sentences": ((per("n_ends") > 0.02) & (per("n_ends") < 0.5), per("n_ends") > 0.9),
        "tables": (per("n_bars") < 0.02, per("n_bars") > 0.15),
    }


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class shares, P(bad vote | class, voted) as rules x classes, posterior of good of each pattern).

    patterns: votes 0 abstain, 1 good, 2 bad. Junk has kinds that trip different
    rules, so the latent classes are good and one kind of bad for each rule. Each
    rule has an accuracy on each class; abstaining tells nothing. Started at the
    demand that every rule pass, which fixes what each class means.
    """
    m = patterns.shape[1]
    if not len(counts):
        return np.zeros(m + 1), np.zeros((m, m + 1)), np.zeros(0)
    bad, good = (patterns == 2).astype(float), (patterns == 1).astype(float)
    post = np.concatenate([~bad.any(1, keepdims=True) + 0.0, bad / np.maximum(bad.sum(1, keepdims=True), 1)], 1)
    expected = np.concatenate([np.full((m, 1), 0.02), np.where(np.eye(m) > 0, 0.9, 0.1)], 1)
    for _ in range(rounds):
        w = counts[:, None] * post
        share = (w.sum(0) + smooth) / (counts.sum() + smooth * (m + 1))
        acc = np.clip((bad.T @ w + smooth * expected) / ((bad + good).T @ w + smooth), 1e-6, 1 - 1e-6)
        log = bad @ np.log(acc) + good @ np.log(1 - acc) + np.log(share)
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return share, acc, post[:, 0]


def _measure(texts: pa.Array) -> list[pa.Array]:
    got = features(*H.text_buffer(texts))
    return [pa.array(got[k], pa.int64()) for k in _LONGS[1:]]


def _votes() -> Column:
    """All rules' votes as one number: a digit of base 3 a rule."""
    votes = [F.when(good, 1).when(bad, 2).otherwise(0) for good, bad in rules().values()]
    return sum((v * F.lit(3**i) for i, v in enumerate(votes)), F.lit(0)).cast("int")


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *_measure(part.column(1))], names=_LONGS)

    read = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(measure, ", ".join(f"{c} long" for c in _LONGS)).withColumn("votes", _votes())


def _posteriors(measured: DataFrame) -> DataFrame:
    """(votes, posterior): one row a vote pattern met, of which there are at most 3**rules."""
    found = measured.groupBy("votes").count().orderBy("votes").collect()
    codes = np.array([r["votes"] for r in found], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(rules())) % 3
    _, _, post = fit_accuracies(patterns, np.array([r["count"] for r in found], float))
    return measured.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True)], "votes int, posterior double")


def _failed(least_words: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _verdict(measured: DataFrame, posteriors: DataFrame, least_words: int, keep_from: float) -> DataFrame:
    out = measured.join(F.broadcast(posteriors), "votes").withColumn("base_failed", _failed(least_words))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def judge(docs: DataFrame, least_words: int = 50, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with its measures, base_failed, kept, posterior and votes.

    kept is false for base_failed rows (under least_words words, or over half of the
    words in repeated 3-word windows), else whether the posterior reaches keep_from.
    A null or empty text has no words and fails; ids may be null or repeat; a posterior
    that ties with keep_from is kept; an empty table gives an empty result; other
    columns, whatever their names, are ignored. A text is held whole by one task, with
    about 30 times its size.
    """
    seen = materialise(_measured(docs, id_col, text_col))
    out = _verdict(seen, _posteriors(seen), least_words, keep_from)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")


def keep_good(docs: DataFrame, least_words: int = 50, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that judge() keeps, with all their columns, whatever their names; else as judge().

    Texts are measured once: rows that may stay are written beside their measures, others' measures alone.
    """
    columns, own = docs.columns, bounded_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at_text = columns.index(text_col)

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                row = batch.column(0).slice(at, 1000)
                yield pa.RecordBatch.from_arrays([row, *_measure(row.flatten()[at_text])], names=["row", *_LONGS[1:]])

    kind = own.schema["row"].dataType.simpleString()
    measured = own.mapInArrow(measure, f"row {kind}, " + ", ".join(f"{c} long" for c in _LONGS[1:])).withColumn("votes", _votes())
    seen = materialise(measured.select(F.when(~_failed(least_words), F.col("row")).alias("row"), "n_words", "n_repeat_words", "votes"))
    return _verdict(seen, _posteriors(seen), least_words, keep_from).filter("kept").select(*(F.col("row").getField(c).alias(c) for c in columns))
