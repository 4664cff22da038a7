"""Removal of long byte strings that occur elsewhere, by bucket-pointer refinement.

Suffixes are sampled where the text itself says so: at q-grams whose fingerprint
falls in one class of `sample`. The initial buckets hold the sampled suffixes that
agree up to the next sample (their phrase). Buckets are then refined in rounds: a
suffix's bucket at depth 2d is the pair of its bucket at depth d and the bucket, at
depth d, of the suffix d samples later, so that each round reuses the identifiers
that the round before has updated and doubles the depth. The pairs are sorted over
all documents; a bucket with one member is final and takes no part in later rounds.

A string of `length` bytes spans a run of whole phrases, whose bucket is the chain of
those of the greatest depth that it holds. Runs in a bucket of their own are final.
What is left differs, if at all, in the ends that stick out of the run. Runs whose
ends agree too are repeated as a whole; only where one run has several different
ends are the strings themselves compared, offset by offset.

Identifiers are fingerprints (61 bits modulo a prime to refine, 128 bits of BLAKE2b to
decide), so that a bucket is refined without renumbering all others. Strings without a sample
go straight to the last comparison. A block of documents asks about each distinct
identifier once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import _blocks as B
from quillon.llm import _hashing as H

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
GRAM = 8
_SLICE = 1 << 19
_FAR = 1 << 60


def _samples(buf: np.ndarray, offs: np.ndarray, one_in: int) -> np.ndarray:
    """Positions of sampled q-grams; whether one is sampled depends on its own bytes alone."""
    shift, found = np.uint64(64 - int(math.log2(one_in))), []
    for a in range(0, len(buf) - GRAM + 1, _SLICE):
        part = np.ascontiguousarray(buf[a : a + _SLICE + GRAM - 1])
        grams = np.ndarray((len(part) - GRAM + 1,), "<u8", part, strides=(1,))
        found.append(np.flatnonzero((grams * np.uint64(0x9E3779B97F4A7C15)) >> shift == 0) + a)
    x = np.concatenate(found) if found else np.zeros(0, np.int64)
    return x[x + GRAM <= offs[np.searchsorted(offs, x, side="right")]] if len(x) else x


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges low..high, and each one's range."""
    n = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of], of


def remove_repeated_strings(docs: DataFrame, length: int = 400, sample: int = 64, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross texts; a string may overlap its own
    repetition. Returns one row a document: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, and with with_text the remaining bytes (kept_bytes).

    A null text is empty; ids may be null or repeat, each row being a document of its
    own; an empty table gives an empty result; other columns are ignored.
    """
    base, n_blocks, total = B.sized(docs, id_col, text_col)
    inner = length - GRAM
    bits = min(64, math.ceil(math.log2(max(total // sample, 2))) + 20)
    shift = np.uint64(64 - bits)
    #: Depths 1, 2, 4 ... of refinement: from half the phrases that a string spans on average, two overlapping buckets cover it.
    rounds = 1 + max(0, int(math.log2(max(1, inner / sample))))
    n_phrase, n_run, n_string = B.buckets(total / sample, n_blocks), B.buckets(total / sample, n_blocks), B.buckets(total / 20, n_blocks)

    def refined(table, reply, upto):
        """Samples, each finished round's buckets (identifiers, and which have other members), and the distinct identifiers of round `upto`."""
        buf, offs = H.text_buffer(table.column("text"))
        x = _samples(buf, offs, sample)
        doc = np.searchsorted(offs, x, side="right") - 1
        held = np.flatnonzero(doc[1:] == doc[:-1])  # samples with a next one in the same text
        identifier = np.zeros(len(x), np.uint64)
        # A phrase longer than a string is of no use: its head stands for it.
        identifier[held] = H.byte_fingerprints(buf, x[held], np.minimum(x[held + 1] + GRAM, x[held] + length), 0, length)
        done, step = [], 1
        for now in range(rounds):
            short, back, count = np.unique(identifier[held] >> shift, return_inverse=True, return_counts=True)
            cut = B.bucket_bounds(short << shift, n_phrase)
            if now == upto:
                return buf, offs, x, doc, done, (short, count, cut)
            shared = np.zeros(len(x), bool)
            if len(held):
                shared[held] = B.bits(B.replies(reply, now), np.diff(cut))[back]
            done.append((identifier, shared))
            # The next round refines a bucket by the bucket at a later offset: both are of this depth, and both have other members.
            held = np.flatnonzero(shared)
            held = held[held + step < len(x)]
            held = held[shared[held + step]]
            held = held[x[held + 2 * step] - x[held] <= inner]
            deeper = np.zeros(len(x), np.uint64)
            deeper[held] = H.combine(identifier[held], identifier[held + step])
            identifier, step = deeper, 2 * step
        return buf, offs, x, doc, done, None

    def ask_buckets(upto):
        def ask(key, table, reply=None):
            *_, (short, count, cut) = refined(table, reply, upto)
            return B.sketch_rows(key[0].as_py(), upto, short, count, cut)

        return (lambda key, table: ask(key, table)) if upto == 0 else lambda key, table, reply: ask(key, table, reply)

    def runs(table, reply):
        """Candidate runs (first and last sample, offsets before the first), and their identifiers grouped."""
        buf, offs, x, doc, done, _ = refined(table, reply, rounds)
        begin, stop = offs[doc], offs[doc + 1]
        last = np.searchsorted(doc, doc, side="right") - 1
        before = np.where(np.concatenate([[False], doc[1:] == doc[:-1]])[: len(x)], np.concatenate([[0], x[:-1]])[: len(x)], begin - 1)
        after = np.append(x[1:], _FAR)[: len(x)]
        after[last == np.arange(len(x))] = _FAR
        most = np.minimum(x - before - 1, inner)
        high = np.minimum(np.searchsorted(x, x + inner, side="right") - 1, last)
        low = np.minimum(np.searchsorted(x, x - most + inner, side="right") - 1, high)
        j, i = _expand(low, high)
        s_low = np.maximum(np.maximum(x[i] + inner - after[j] + 1, x[i] + length - stop[i]), 0)
        s_high = np.minimum(most[i], x[i] + inner - x[j])
        ok, run = s_low <= s_high, np.zeros(len(i), np.uint64)
        for r, (identifier, shared) in enumerate(done):
            depth, living = 1 << r, np.concatenate([[0], np.cumsum(shared)])
            mine = np.flatnonzero(ok & (j - i >= depth) & ((j - i < 2 * depth) | (r == rounds - 1)))
            # A run is a chain of buckets of the greatest depth that it holds; each of them needs other members.
            a, b = i[mine], j[mine] - depth
            whole = living[b + 1] - living[a] == b + 1 - a
            ok[mine[~whole]] = False
            mine, at, b = mine[whole], a[whole], b[whole]
            chain = identifier[at]
            while (more := at + depth < b).any():
                at = np.where(more, at + depth, at)
                chain = np.where(more, H.combine(chain, identifier[at]), chain)
            run[mine] = H.combine(chain, identifier[b])
        i, j, s_low, s_high, run = i[ok], j[ok], s_low[ok], s_high[ok], run[ok]
        gram = np.ndarray((max(0, len(buf) - GRAM + 1),), "<u8", np.ascontiguousarray(buf), strides=(1,))[x[i]] if len(i) else run
        run = H.combine(H.combine(run, gram), (j - i).astype(np.uint64))
        start, end = x[i] - s_high, x[i] - s_low + length
        order = np.argsort(start, kind="stable")
        run, s_low, s_high, start, end = (a[order] for a in (run, s_low, s_high, start, end))
        exact = [H.combine(h, (s_low * 1024 + s_high).astype(np.uint64)) for h in H.range_digests(buf, start, end)]
        first, group, size = B.grouped(run, *exact)
        return buf, offs, x, doc, (start, end, s_high - s_low), (run[first], exact[0][first], exact[1][first]), first, group, size

    def ask_runs(key, table, reply):
        *_, (run, e0, e1), _, _, size = runs(table, reply)
        cut, out = B.bucket_bounds(run, n_run), []
        for b in range(n_run):
            s = slice(cut[b], cut[b + 1])
            if cut[b + 1] > cut[b]:
                out.append((b, B.join(run[s].tobytes(), e0[s].tobytes(), e1[s].tobytes(), np.packbits(size[s] > 1).tobytes())))
        return B.rows(key[0].as_py(), rounds, out)

    def refine(table):
        """0: alone. 1: repeated with its ends. 2: the run is repeated with other ends. 3: as 1, and the one that shows its strings to those of 2."""
        # This runs again for each later phase, and rows come in any order: the one that shows is that of the smallest block each time.
        table = table.sort_by("block")
        parts = [B.split(p) for p in table.column("payload").to_pylist()]
        cols = [[np.frombuffer(p[c], np.uint64) for p in parts] for c in range(3)]
        sizes = [len(a) for a in cols[0]]
        run, e0, e1 = (np.concatenate(c) for c in cols)
        many = np.concatenate([np.unpackbits(np.frombuffer(p[3], np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)])
        first, group, size = B.grouped(run, e0, e1)
        size = size + np.bincount(group, weights=many, minlength=len(first)).astype(np.int64)
        _, of_run, ends = B.grouped(run[first])
        other = (ends[of_run] > 1)[group]
        twice = (size > 1)[group]
        code = np.where(twice, 1, np.where(other, 2, 0)).astype(np.uint8)
        code[first[other[first] & twice[first]]] = 3
        at = np.cumsum(sizes)
        return B.answered(table, [code[e - n : e].tobytes() for e, n in zip(at, sizes, strict=True)])

    def strings(table, reply):
        """Covered ranges known so far, and the single strings still to be compared."""
        buf, offs, x, doc, (start, end, spread), (run, *_), first, group, _ = runs(table, reply)
        got = dict(B.replies(reply, rounds))
        cut = B.bucket_bounds(run, n_run)
        code = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(got[b], np.uint8) for b in range(n_run) if cut[b + 1] > cut[b])])
        mine = code[group] if len(group) else np.zeros(0, np.uint8)
        known = (mine == 1) | (mine == 3)
        shown = np.zeros(len(group), bool)
        shown[first[code >= 2]] = True
        p, _ = _expand(start[shown], start[shown] + spread[shown])
        # Strings without any sample: between two samples, or a sample and an end of the text.
        edge = np.concatenate([x, offs[:-1] - 1])
        text = np.concatenate([doc, np.arange(len(offs) - 1)])
        order = np.lexsort((edge, text))
        edge, text = edge[order], text[order]
        after = np.append(edge[1:], _FAR)
        after[np.append(text[1:] != text[:-1], True)] = _FAR
        bare, _ = _expand(edge + 1, np.minimum(after - inner - 1, offs[text + 1] - length))
        p = np.sort(np.concatenate([p, bare]))
        h = H.range_digests(buf, p, p + length)
        one, back, size = B.grouped(*h)
        return buf, offs, (start[known], end[known]), p, (h[0][one], h[1][one]), back, size

    def ask_strings(key, table, reply):
        *_, (h0, h1), _, size = strings(table, reply)
        cut, out = B.bucket_bounds(h0, n_string), []
        for b in range(n_string):
            s = slice(cut[b], cut[b + 1])
            if cut[b + 1] > cut[b]:
                out.append((b, B.join(h0[s].tobytes(), h1[s].tobytes(), np.packbits(size[s] > 1).tobytes())))
        return B.rows(key[0].as_py(), rounds + 1, out)

    def compare(table):
        parts = [B.split(p) for p in table.column("payload").to_pylist()]
        h = [np.concatenate([np.frombuffer(p[c], np.uint64) for p in parts]) for c in (0, 1)]
        sizes = [len(p[0]) // 8 for p in parts]
        many = np.concatenate([np.unpackbits(np.frombuffer(p[2], np.uint8), count=n) for p, n in zip(parts, sizes, strict=True)])
        first, group, size = B.grouped(*h)
        twice = (size + np.bincount(group, weights=many, minlength=len(first)) > 1)[group]
        return B.answered(table, [np.packbits(twice[e - n : e]).tobytes() for e, n in zip(np.cumsum(sizes), sizes, strict=True)])

    def cut_out(key, table, reply):
        buf, offs, (start, end), p, (h0, _), back, _ = strings(table, reply)
        twice = B.bits(B.replies(reply, rounds + 1), np.diff(B.bucket_bounds(h0, n_string)))[back] if len(p) else np.zeros(0, bool)
        edge = np.zeros(len(buf) + 1, np.int32)
        np.add.at(edge, np.concatenate([start, p[twice]]), 1)
        np.subtract.at(edge, np.concatenate([end, p[twice] + length]), 1)
        gone = np.cumsum(edge[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[offs[:-1][(offs[:-1] < len(buf))]] |= gone[offs[:-1][offs[:-1] < len(buf)]]
        per = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offs])
        digest, texts = [], []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            left = buf[a:b][~gone[a:b]].tobytes()
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                texts.append(left)
        out = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(per(gone), pa.int64()), "n_spans": pa.array(per(opens), pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept_bytes": pa.array(texts, pa.binary())} if with_text else {}))

    blocks = base.groupBy("block")
    by_bucket = lambda df, f: df.groupBy("bucket").applyInArrow(f, B.PAYLOAD)
    known = by_bucket(blocks.applyInArrow(ask_buckets(0), B.PAYLOAD), B.merge_sketches)
    ask = lambda f: blocks.cogroup(known.groupBy("block")).applyInArrow(f, B.PAYLOAD)
    for r in range(1, rounds):
        known = known.unionByName(by_bucket(ask(ask_buckets(r)), B.merge_sketches))
    known = known.unionByName(by_bucket(ask(ask_runs), refine))
    known = known.unionByName(by_bucket(ask(ask_strings), compare))
    return blocks.cogroup(known.groupBy("block")).applyInArrow(cut_out, OUT + (", kept_bytes binary" if with_text else ""))
