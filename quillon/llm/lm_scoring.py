"""Language-model scores from a weighted backoff automaton.

Counts of n-grams up to `order` are gathered from all training documents. A gram of
fewer than `order` words is a state (the empty one is the root). A state has an arc
for each word seen after it, weighted with its smoothed log-probability, and a
failure arc to the state of its last words but one fewer, weighted with the mass that
is left for words not seen. An arc leads to the longest state that ends in the word.
All weights of a state, failures followed, sum to one.

Each text is traversed once from left to right: at a token the carried state follows
failure arcs until it has an arc for the word, then that arc, and the weights add up.
A state is at most order - 1 words long, so after as many tokens the carried state no
longer depends on where the traversal began: a block's tokens are traversed in many
lanes side by side, each begun that many tokens early.

The model is never in one place: each block of documents fetches the counts of its
own distinct grams, and so holds the part of the automaton that its texts can reach.
Words are matched by 77 bits of BLAKE2b. Longer grams are matched by fingerprints
long enough that one never seen is taken for another with a probability of 1 in
65,536.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import _blocks as B
from quillon.llm import _hashing as H

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
LANE = 256
_KEY = np.uint64(3)  # bits of the first half of a word's digest that are left out, so that gaps take six bytes


def crc_bucket(ids: list, n: int) -> np.ndarray:
    """crc32 of each id as text, modulo n; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % n for x in ids], np.int64)


class Automaton:
    """The states and arcs that one stream of tokens can reach.

    count[k][t]: training count of the k words that end at token t (k from 1 on).
    before[k][t]: count of the state of k words before t; 0 where the text has fewer.
    root[t]: probability of the word at t from the root.
    """

    def __init__(self, count: list[np.ndarray], before: list[np.ndarray], root: np.ndarray, mass: tuple[float, ...]):
        self.order, self.known = len(count) - 1, count[1] > 0
        p, self.has, self.arc, self.fail = root, [None], [np.log10(root)], [None]
        for k in range(1, self.order):  # arcs and failure arc of the states of k words
            whole = before[k] + mass[k - 1]
            p = np.where(before[k] > 0, (count[k + 1] + mass[k - 1] * p) / whole, p)
            self.has.append((count[k + 1] > 0) & (before[k] > 0))
            self.arc.append(np.log10(p))
            self.fail.append(np.where(before[k] > 0, np.log10(mass[k - 1] / whole), 0.0))

    def traverse(self, first: np.ndarray) -> np.ndarray:
        """Each token's weight; first: where texts begin (their state is the start, one symbol long)."""
        n, warm = len(self.known), self.order - 1
        weight, begins = np.zeros(n), np.zeros(n, bool)
        begins[first] = True
        lanes = np.arange(0, n, LANE)
        state = np.zeros(len(lanes), np.int64)  # the words of each lane's state
        for step in range(-warm, LANE):
            at = lanes + step
            live = np.flatnonzero((at >= 0) & (at < n))
            t = at[live]
            held = np.where(begins[t], min(1, self.order - 1), state[live])
            total, goes = np.zeros(len(t)), np.zeros(len(t), np.int64)
            for k in range(self.order - 1, 0, -1):
                mine = np.flatnonzero(held == k)
                arc = self.has[k][t[mine]]
                taken, fails = mine[arc], mine[~arc]
                total[taken] += self.arc[k][t[taken]]
                goes[taken] = min(k + 1, self.order - 1)
                held[taken] = -1
                total[fails] += self.fail[k][t[fails]]
                held[fails] = k - 1
            mine = np.flatnonzero(held == 0)
            total[mine] += self.arc[0][t[mine]]
            goes[mine] = self.known[t[mine]] if self.order > 1 else 0
            state[live] = goes
            if step >= 0:
                weight[t] = total
        return weight


def score(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, mass: tuple[float, ...] = (60.0, 30.0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all whole texts with an n-gram model of the documents outside one fold.

    Tokens are the lower-cased (A-Z) words, then one end. base_score uses words
    alone, smoothed by a half. score is that of the automaton of order len(mass) + 1:
    after a state of k words met c times, mass[k - 1] / (c + mass[k - 1]) goes to the
    shorter state. Both are log10. A null or empty text is its end alone; a null id
    falls in the fold of the empty text; repeated rows each count; ties don't arise,
    as counts alone decide; an empty table gives an empty result; other columns,
    whatever their names, are ignored. A text is held whole by one task, with about
    40 times its size.
    """
    base, n_blocks, total = B.sized(docs, id_col, text_col)
    order = len(mass) + 1
    n_words, n_grams = B.buckets(total / 25, n_blocks), B.buckets(total / 6, n_blocks)
    bits = min(64, math.ceil(math.log2(max(total // 5, 2))) + 16)
    start, stop = (H.mix(np.array([x], np.uint64))[0] for x in (99, 7))

    def tokens_of(table):
        """All tokens (words, then the end) as 128-bit fingerprints, with each text's first token and number, and whether it is learnt from."""
        buf, offs = H.text_buffer(table.column("text"))
        low, n = H.lower_ascii(buf), len(offs) - 1
        starts, ends, ptr = H.word_spans(low, offs)
        which, values = H.distinct_ranges(low, starts, ends)
        at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(ptr))
        word = np.full(len(starts) + n, len(values))
        word[at] = which
        h = [np.append(half, stop) for half in H.digests(values)]
        first, size = ptr[:-1] + np.arange(n), np.diff(ptr) + 1
        return word, h, first, size, crc_bucket(table.column("doc_id").to_pylist(), folds) != held_out_fold

    def grams_of(word, h, first, size):
        """For k from 2 on: fingerprints of the k symbols that end at each token (the start counts as one), and where there are as many."""
        place = np.arange(len(word)) - np.repeat(first, size)
        out, run = [], h[0][word]
        for k in range(2, order + 1):
            # The symbol before a run: a token, or the start.
            before = np.empty(len(word), np.uint64)
            before[k - 1 :] = h[0][word[: max(0, len(word) - k + 1)]]
            before[place == k - 2] = start
            run = H.combine(before, run)
            out.append((run >> np.uint64(64 - bits), place >= k - 2))
        return out

    def distinct(table):
        word, h, first, size, train = tokens_of(table)
        mine = np.repeat(train, size)
        by = np.argsort(h[0], kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        word, h = rank[word], [x[by] for x in h]
        found = []
        for g, whole in grams_of(word, h, first, size):
            keys, back = np.unique(g[whole], return_inverse=True)
            at = np.full(len(word), -1)
            at[whole] = back
            found.append((keys, np.bincount(back[mine[whole]], minlength=len(keys)), at))
        return word, h, np.bincount(word[mine], minlength=len(by)), found, first, size, train

    def cuts(h, found):
        return [B.bucket_bounds(h[0], n_words), *(B.bucket_bounds(keys << np.uint64(64 - bits), n_grams) for keys, *_ in found)]

    def ask(key, table):
        _, h, count, found, *_ = distinct(table)
        cut, *gram_cuts = cuts(h, found)
        out = []
        for b in range(n_words):  # every bucket hears from every block, and so can tell it its totals
            s = slice(cut[b], cut[b + 1])
            out.append((b, B.join(B.pack_sorted(h[0][s] >> _KEY), (h[1][s] >> np.uint64(48)).astype("<u2").tobytes(), B.pack_counts(count[s]))))
        for k, ((keys, n, _), c) in enumerate(zip(found, gram_cuts, strict=True)):
            for b in range(n_grams):
                s = slice(c[b], c[b + 1])
                if c[b + 1] > c[b]:
                    out.append((n_words + k * n_grams + b, B.join(B.pack_gaps(keys[s]), B.pack_counts(n[s]))))
        return B.rows(key[0].as_py(), 0, out)

    def add_up(table):
        parts = [B.split(p) for p in table.column("payload").to_pylist()]
        if table.column("bucket")[0].as_py() < n_words:
            keys = [np.concatenate([B.unpack_sorted(p[0]) for p in parts]), np.concatenate([np.frombuffer(p[1], "<u2") for p in parts])]
        else:
            keys = [np.concatenate([B.unpack_gaps(p[0]) for p in parts])]
        counts = [B.unpack_counts(p[-1]) for p in parts]
        _, group, _ = B.grouped(*keys)
        sums = np.bincount(group, weights=np.concatenate(counts)).astype(np.int64) if len(group) else np.zeros(0, np.int64)
        totals = np.array([sums.sum(), (sums > 0).sum()], np.int64).tobytes()
        at, out = 0, []
        for c in counts:
            out.append(B.join(totals, B.pack_counts(sums[group[at : at + len(c)]])))
            at += len(c)
        return B.answered(table, out)

    def traverse(key, table, reply):
        word, _, _, found, first, size, train = distinct(table)
        got = {b: B.split(p) for b, p in B.replies(reply, 0)}
        counts = lambda low, n: np.concatenate([np.zeros(0, np.int64), *(B.unpack_counts(got[b][1]) for b in range(low, low + n) if b in got)])
        n, v = np.sum([np.frombuffer(got[b][0], np.int64) for b in range(n_words)], axis=0)
        of_word = counts(0, n_words)
        count = [np.zeros(0), of_word[word]]
        for k, (_, _, at) in enumerate(found):
            count.append(np.where(at >= 0, np.append(counts(n_words + k * n_grams, n_grams), 0)[at], 0))
        before = [np.zeros(0), *(np.append(0, c[:-1]) for c in count[1:order])]
        place = np.arange(len(word)) - np.repeat(first, size)
        for k in range(1, order):  # states within the text; of the start and k - 1 words, c[first] counts visits
            before[k][place < k - 1] = 0
        if order > 1:
            before[1][first] = of_word[word[first[0] + size[0] - 1]]  # each training text visits the start once, and the end
        root = (count[1] + 0.5) / (n + 0.5 * (v + 1))
        weight = Automaton(count, before, root, mass).traverse(first)
        total_of = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pa.array(~train), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(total_of((count[1] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(size), int(n)), pa.int64()), "base_score": pa.array(total_of(np.log10(root)), pa.float64()), "score": pa.array(total_of(weight), pa.float64()),
        })

    by_block = base.groupBy("block")
    answers = by_block.applyInArrow(ask, B.PAYLOAD).groupBy("bucket").applyInArrow(add_up, B.PAYLOAD)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(traverse, OUT)
