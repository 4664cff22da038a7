"""Bounded-space online packing of tokenised documents.

Each partition keeps a fixed number of open windows. A piece goes to the window
that it fills best; when none has room, the fullest is emitted, after its
remaining room is filled with the head of the piece if that is worth a cut. What
is open at the end of a partition is merged with the other partitions' leftovers
by the same rule, uncut.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _hashing as H
from quillon.llm._shared import bounded_batches, materialise

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Words, and parts of words, that a worker remembers; about 100 MB each.
_CACHED = 250_000


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordEncoder:
    """Token ids of texts, word by word with a cache.

    For tokenizers that drop white space and never join words across it, as
    word_bpe_49k does: a text's ids are its words' ids on end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(_byte_chars())})
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        """Words go; their parts, which most new words are made of, stay."""
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def part(self, word: str) -> list[int]:
        ids = self.parts.get(word)
        if ids is None:
            ids = self.parts[word] = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.chars))] if word else []
        return ids

    def word(self, raw: bytes) -> list[int]:
        word = raw.decode()
        if m := _LATIN.fullmatch(word):
            return self.part(m[1].lower()) + self.part(m[2])
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def index(self, raw: bytes) -> int:
        at = self.known.get(raw)
        if at is None:
            ids, at = self.word(raw), len(self.known)
            self.known[raw] = at
            if at + 2 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.start[at + 1] = self.used
        return at

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids on end, and n + 1 pointers."""
        if len(self.parts) > _CACHED:
            self.clear()
        elif len(self.known) > _CACHED:
            self.forget()
        starts, ends, ptr = H.word_spans(buf, offs)
        which, values = H.distinct_ranges(buf, starts, ends)
        known = self.known
        found = [known.get(v, -1) for v in values]
        at = np.array([k if k >= 0 else self.index(v) for k, v in zip(found, values, strict=True)], np.int64)[which]
        begin, count = self.start[at], self.start[at + 1] - self.start[at]
        cum = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - cum[:-1], count) + np.arange(cum[-1])]
        return ids, cum[ptr]


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a vocabulary file."""
    known = H.process_cache("encoders")
    if path not in known:
        known[path] = WordEncoder(path)
    return known[path]


class OpenWindows:
    """At most `most` open windows of `size`, ordered by room; place() returns what is closed."""

    def __init__(self, size: int, most: int, next_id: int):
        self.size, self.most, self.next_id = size, most, next_id
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def open(self, items: list, length: int) -> None:
        self.held[self.next_id] = items
        bisect.insort(self.room, (self.size - length, self.next_id))
        self.next_id += 1

    def best(self, length: int) -> int | None:
        at = bisect.bisect_left(self.room, (length, -1))
        return at if at < len(self.room) else None

    def add(self, at: int, items: list, length: int) -> list | None:
        """Put items in the at-th window; if that fills it, close and return it."""
        room, key = self.room.pop(at)
        self.held[key] += items
        if room == length:
            return self.held.pop(key)
        bisect.insort(self.room, (room - length, key))
        return None

    def close_fullest(self) -> list:
        return self.held.pop(self.room.pop(0)[1])


def _table(windows: list[tuple[int, list]]) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _NAMES]
    for key, pieces in windows:
        at = 0
        for doc, start, length, crc, total in pieces:
            for c, v in zip(cols, (doc, start, length, crc, total, key, at), strict=True):
                c.append(v)
            at += length
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, open_windows: int = 64, least_cut: int = 64, merge_windows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens. One row a piece.

    A document's ids are the tokenizer's and end_id. Texts longer than `size` are
    cut into full sequences and a rest. At most open_windows are held a partition;
    room under least_cut tokens is left as padding rather than cut for. A null or
    empty text is its end_id alone; ids may be null or repeat (each row is packed);
    an empty table gives an empty result; other columns are ignored.
    """

    def packed(batches):
        from pyspark import TaskContext

        own, enc = TaskContext.get().partitionId() << 32, encoder(tokenizer)
        held = OpenWindows(size, open_windows, 0)

        def numbered(items):
            nonlocal own
            own += 1
            return own - 1, items

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                buf, offs = H.text_buffer(part.column(1))
                ids, ptr = enc.encode(buf, offs)
                done = []
                for d, doc in enumerate(part.column(0).to_pylist()):
                    mine = np.append(ids[ptr[d] : ptr[d + 1]], np.uint32(end_id)).astype("<u4")
                    total, pos = len(mine), 0

                    def piece(n):
                        return (doc, pos, n, zlib.crc32(mine[pos : pos + n].tobytes()), total)  # noqa: B023

                    while pos < total:
                        n = min(size, total - pos)
                        if n == size:
                            done.append(numbered([piece(n)]))
                        elif (k := held.best(n)) is not None:
                            if full := held.add(k, [piece(n)], n):
                                done.append(numbered(full))
                        elif len(held.room) < held.most:
                            held.open([piece(n)], n)
                        elif (room := held.room[0][0]) >= least_cut:
                            n = room
                            done.append(numbered(held.add(0, [piece(n)], n)))
                        else:
                            done.append(numbered(held.close_fullest()))
                            n = 0
                        pos += n
                yield from marked(done, False)
        enc.clear()  # an idle worker keeps no words
        while held.room:
            yield from marked([numbered(held.close_fullest())], True)

    def marked(windows, is_open):
        out = _table(windows)
        if out.num_rows:
            yield out.append_column("open", pa.array([is_open] * out.num_rows))

    def merged(table):
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).select(_NAMES).to_pylist()
        windows: dict[int, list] = {}
        for r in rows:
            windows.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        held, done = OpenWindows(size, len(windows), 0), []
        for items in sorted(windows.values(), key=lambda w: -sum(x[2] for x in w)):
            n = sum(x[2] for x in items)
            if (k := held.best(n)) is None:
                held.open(list(items), n)
            elif full := held.add(k, list(items), n):
                done.append(full)
        done += held.held.values()
        ids = sorted(windows)  # each merged sequence keeps the number of one of its windows
        return pa.Table.from_batches([_table(list(zip(ids, done, strict=False)))])

    read = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = max(1, -(-read.rdd.getNumPartitions() * open_windows // merge_windows))
    first = materialise(read.mapInArrow(packed, PIECE + ", open boolean"))
    rest = first.filter("open").drop("open").withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    return first.filter("not open").drop("open").unionByName(rest.groupBy("part").applyInArrow(merged, PIECE))
