"""Substring dedup over word windows: a Count-min prefilter, then exact grouping.

First every block sketches its windows: a window adds one to a counter of a wide
Count-min row. The partition sketches are merged counter by counter, and since a
counter may only overestimate, a window whose counter stays below two is in no
other place. Sketches are kept sparse (gaps between the counters that are set, a
byte or two a window), so the width grows with the input and nothing is
broadcast. A second pass groups only windows estimated repeated, exactly, by
128-bit fingerprints; no window is lost to the estimate.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import _blocks as B
from quillon.llm import _hashing as H

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_LAST = np.iinfo(np.int64).max


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


def remove_repeated_windows(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller id.

    Windows are `window` words on end and judged on the input. Returns one row a
    document: doc_id, n_words, n_removed, kept_sha256, and with with_text the kept
    words joined by one space (kept_text).

    A null text has no words. A null id counts as larger than every other; rows
    with equal ids (repeated rows) don't remove each other. An empty table gives an
    empty result; other columns are ignored.
    """
    base, n_blocks, total = B.sized(docs, id_col, text_col)
    slots = min(63, math.ceil(math.log2(max(total // 5, 2))) + 5)
    n_sketch, n_exact = B.buckets(total / 5, n_blocks), B.buckets(total / 10, n_blocks)

    def windows_of(table, wide):
        buf, offs = H.text_buffer(table.column("text"))
        starts, ends, ptr = H.word_spans(buf, offs)
        at, doc = H.windows(ptr, window)
        which, values = H.distinct_ranges(buf, starts, ends)
        halves = H.digests(values)[: 2 if wide else 1]
        return buf, offs, ptr, at, doc, [H.runs_of(h[which], window)[at] for h in halves]

    def sketch_of(h):
        slot, back = np.unique(h >> np.uint64(64 - slots), return_inverse=True)
        return slot, back, B.bucket_bounds(slot << np.uint64(64 - slots), n_sketch)

    def sketch(key, table):
        h = windows_of(table, False)[5][0]
        raw = h >> np.uint64(64 - slots)
        slot, count = np.unique(raw, return_counts=True)
        cut = B.bucket_bounds(slot << np.uint64(64 - slots), n_sketch)
        out = []
        for b in range(n_sketch):
            s = slice(cut[b], cut[b + 1])
            if cut[b + 1] > cut[b]:
                gaps = B.pack_gaps(slot[s])
                out.append((b, len(gaps).to_bytes(8, "little") + gaps + np.packbits(count[s] > 1).tobytes()))
        return B.rows(key[0].as_py(), 0, out)

    def merge_sketches(table):
        parts = [(p, int.from_bytes(p[:8], "little")) for p in table.column("payload").to_pylist()]
        slot = [B.unpack_gaps(p[8 : 8 + n]) for p, n in parts]
        seen, back, count = np.unique(np.concatenate(slot), return_inverse=True, return_counts=True)
        for s, (p, n) in zip(slot, parts, strict=True):
            count[np.searchsorted(seen, s)] += np.unpackbits(np.frombuffer(p, np.uint8, offset=8 + n), count=len(s))
        repeated, at, out = (count > 1)[back], 0, []
        for s in slot:
            out.append(np.packbits(repeated[at : at + len(s)]).tobytes())
            at += len(s)
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))

    def candidates(table, reply):
        """Distinct windows estimated repeated, sorted, each with its smallest document."""
        buf, offs, ptr, at, doc, (h1, h2) = windows_of(table, True)
        slot, back, cut = sketch_of(h1)
        pick = np.flatnonzero(B.bits(B.replies(reply, 0), np.diff(cut))[back]) if len(h1) else np.zeros(0, np.int64)
        at, doc, h1, h2, ids = at[pick], doc[pick], h1[pick], h2[pick], _ids(table)
        order = np.lexsort((h2, h1))
        s1, s2 = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        first = np.flatnonzero(new)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[doc[order]], first) if len(first) else ids[:0]
        return buf, offs, ptr, at, ids[doc], group, s1[first], s2[first], least

    def ask(key, table, reply):
        *_, h1, h2, least = candidates(table, reply)
        cut, out = B.bucket_bounds(h1, n_exact), []
        for b in range(n_exact):
            s = slice(cut[b], cut[b + 1])
            if n := int(cut[b + 1] - cut[b]):
                ids, rank = np.unique(least[s], return_inverse=True)
                out.append((b, np.array([n, len(ids)], np.int64).tobytes() + ids.tobytes() + h1[s].tobytes() + h2[s].tobytes() + rank.astype(np.uint32 if len(ids) > 65535 else np.uint16).tobytes()))
        return B.rows(key[0].as_py(), 1, out)

    def group_exactly(table):
        h1, h2, ids, sizes = [], [], [], []
        for p in table.column("payload").to_pylist():
            n, m = (int(x) for x in np.frombuffer(p, np.int64, 2))
            own = np.frombuffer(p, np.int64, m, 16)
            h1.append(np.frombuffer(p, np.uint64, n, 16 + 8 * m))
            h2.append(np.frombuffer(p, np.uint64, n, 16 + 8 * m + 8 * n))
            ids.append(own[np.frombuffer(p, np.uint32 if m > 65535 else np.uint16, n, 16 + 8 * m + 16 * n)])
            sizes.append(n)
        h1, h2, ids = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[order], first)[np.cumsum(new) - 1]
        earlier = np.empty(len(order), bool)
        earlier[order] = least < ids[order]
        ends = np.cumsum(sizes)
        out = [np.packbits(earlier[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))

    def keep(key, table, reply):
        buf, offs, ptr, at, own, group, h1, _, least = candidates(table, reply)
        earlier = B.bits(B.replies(reply, 1), np.diff(B.bucket_bounds(h1, n_exact)))
        gone = earlier[group] | (least[group] < own) if len(group) else np.zeros(0, bool)
        edge = np.zeros(int(ptr[-1]) + 1, np.int64)
        np.add.at(edge, at[gone], 1)
        np.subtract.at(edge, at[gone] + window, 1)
        kept = np.cumsum(edge)[:-1] == 0
        raw, words, removed, digest, texts = buf.tobytes(), np.diff(ptr), [], [], []
        for d in range(len(offs) - 1):
            mine = kept[ptr[d] : ptr[d + 1]]
            own_words = raw[offs[d] : offs[d + 1]].split()
            n = len(mine) - int(mine.sum())
            if n:
                own_words = [w for w, k in zip(own_words, mine.tolist(), strict=True) if k]
            text = b" ".join(own_words)
            removed.append(n)
            digest.append(hashlib.sha256(text).hexdigest())
            if with_text:
                texts.append(text.decode())
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    by_block = base.groupBy("block")
    sketched = by_block.applyInArrow(sketch, B.PAYLOAD).groupBy("bucket").applyInArrow(merge_sketches, B.PAYLOAD)
    asked = by_block.cogroup(sketched.groupBy("block")).applyInArrow(ask, B.PAYLOAD)
    answered = asked.groupBy("bucket").applyInArrow(group_exactly, B.PAYLOAD)
    return by_block.cogroup(sketched.unionByName(answered).groupBy("block")).applyInArrow(keep, OUT + (", kept_text string" if with_text else ""))
