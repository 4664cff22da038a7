"""Token counts by a byte-level BPE, with huge documents encoded in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Each is encoded with
offsets, in any task; where the pre-tokens of two neighbours begin at the same
place, the left one's tokens before it and the right one's after it are those of
the whole text:

* the pre-tokenizer scans from left to right and never looks back, so two scans
  that both start a pre-token at one place go on alike from there;
* what a chunk says near its own end may change with the text that follows, so
  places within `margin` characters of the end (the longest special string, or the
  three characters that a contraction looks ahead) aren't used;
* merges never cross a pre-token.

Documents with an overlap without a common place, such as a run of letters longer
than it, are cut again with overlaps and chunks 8 times as long, at last whole.
"""

from __future__ import annotations

import json
import os
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _hashing as H
from quillon.llm._shared import bounded_batches, materialise, release

#: Units of text whose counts a worker remembers, and the longest of them in bytes: some 150 MB.
CACHED, LONGEST = 600_000, 48
#: Bytes of text that are counted at once; their arrays take some 30 times as much.
SLICE_BYTES = 4 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_ENCODED = "row long, k long, doc_id long, n_bytes long, last boolean, n_tokens long, head array<long>, head_tokens array<long>, tail array<long>, tail_tokens array<long>"


class Counter:
    """Counts and offsets of a tokenizer of the kind that may be cut: byte-level BPE, no normalizer, no added prefix."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        if spec.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer can be cut")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"] or set(t["content"]) & set(" \t\n\r") for t in added):
            raise ValueError(f"{path}: added tokens with blanks can't be cut")
        spec["post_processor"] = spec["truncation"] = spec["padding"] = None  # post-processing trims offsets
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.margin = max([3, *(len(t["content"]) for t in added)])
        self.known: dict[bytes, int] = {}

    def units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the units of texts, and each text's range of them (n + 1 pointers).

        A unit starts where a blank follows what can't be a blank: a printed ASCII character, or one of two
        bytes from U+00C0 on. A pre-token always ends there, and none needs to look beyond.
        """
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        begin = np.zeros(len(buf), bool)
        before = _PRINTED[buf[:-1]]
        before[1:] |= (buf[:-2] >= 0xC3) & (buf[:-2] < 0xE0)
        begin[1:] = _BLANK[buf[1:]] & before
        begin[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(begin)
        return starts, np.searchsorted(starts, offs)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, unit by unit; equal units are encoded once while they are remembered."""
        buf, offs = H.text_buffer(texts)
        starts, ptr = self.units(buf, offs)
        which, values = H.distinct_ranges(buf, starts, np.append(starts[1:], len(buf))) if len(starts) else (starts, [])
        known = self.known
        if len(known) > CACHED:
            known.clear()
        counts = [known.get(v, -1) for v in values]
        new = [i for i, c in enumerate(counts) if c < 0]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch([values[i].decode() for i in some], add_special_tokens=False), strict=True):
                counts[i] = len(e)
                if len(values[i]) <= LONGEST:
                    known[values[i]] = counts[i]
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(counts, np.int64)[which] if len(which) else which)])
        return sums[ptr[1:]] - sums[ptr[:-1]]

    def places(self, text: str, head: int, tail: int, end: int) -> tuple[int, list[list[int]]]:
        """Tokens of a chunk; where its pre-tokens begin up to `head` and from `tail` to `end`, with the tokens before."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        word, begin = np.array(e.word_ids, np.int64), np.array([a for a, _ in e.offsets], np.int64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        at = begin[first]
        near, far = at <= head, (at >= tail) & (at <= end)
        return len(word), [at[near].tolist(), first[near].tolist(), at[far].tolist(), first[far].tolist()]


def counter(path: str) -> Counter:
    """The process's counter for a vocabulary file."""
    known = H.process_cache("counters")
    if path not in known:
        known[path] = Counter(path)
    return known[path]


def _short(docs: DataFrame, tokenizer: str) -> DataFrame:
    def counted(batches):
        c = counter(tokenizer)
        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(c.count(part.column(2)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
                at = end
        c.known.clear()  # an idle worker keeps nothing

    return docs.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def _cut(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of (row, doc_id, n_bytes, text), dealt out evenly."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def cut(batches):
        step = chunk - overlap
        for batch in batches:
            for row, doc, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, out = max(1, -(-(len(text) - overlap) // step)), []
                for k in range(n):
                    out.append({"row": row, "doc_id": doc, "n_bytes": size, "k": k, "start": k * step, "last": k == n - 1, "text": text[k * step : k * step + chunk]})
                    if len(out) * chunk > SLICE_BYTES or k == n - 1:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []

    return rows.mapInArrow(cut, "row long, doc_id long, n_bytes long, k long, start long, last boolean, text string").repartition("row", "k")


def _encoded(chunks: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    def encoded(batches):
        c = counter(tokenizer)
        for batch in batches:
            cols: list[list] = [[] for _ in range(10)]
            for row, doc, size, k, start, last, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n, (head, head_n, tail, tail_n) = c.places(text, overlap if k else -1, len(text) if last else chunk - overlap, -1 if last else chunk - c.margin)
                for col, v in zip(cols, (row, k, doc, size, last, n, [start + p for p in head], head_n, [start + p for p in tail], tail_n), strict=True):
                    col.append(v)
            types = [pa.int64()] * 4 + [pa.bool_(), pa.int64()] + [pa.list_(pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=[p.split()[0] for p in _ENCODED.split(", ")])

    return chunks.mapInArrow(encoded, _ENCODED)


def _spliced(parts: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens, failed): neighbours joined at the first place that both have."""
    left = parts.filter("not last").select("row", "k", "doc_id", "n_bytes", "tail", "tail_tokens")
    right = parts.filter("k > 0").select("row", (F.col("k") - 1).alias("k"), "head", "head_tokens")
    link = left.join(right, ["row", "k"]).withColumn("place", F.array_min(F.array_intersect("tail", "head")))
    at = lambda places, tokens: F.get(F.col(tokens), (F.array_position(places, F.col("place")) - 1).cast("int"))
    link = link.select("row", "doc_id", "n_bytes", (at("tail", "tail_tokens") - at("head", "head_tokens")).alias("n"), F.col("place").isNull().alias("failed"))
    whole = parts.filter("last").select("row", "doc_id", "n_bytes", F.col("n_tokens").alias("n"), F.lit(False).alias("failed"))
    return link.unionByName(whole).groupBy("row", "doc_id", "n_bytes").agg(F.sum("n").alias("n_tokens"), F.max("failed").alias("failed"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = 8192, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, n_bytes (UTF-8), n_tokens as the tokenizer gives them for the whole text, and over_limit.

    Texts of more than `chunk` characters are encoded in chunks, others by units that no token crosses. Special
    strings are single tokens, as is the library's default. A null or empty text has no bytes and no tokens;
    null or repeated ids and repeated rows are counted row by row; an empty table gives no rows; other columns,
    whatever their names, are ignored. A long text is held whole only by the task that cuts it (some 6 times its
    size); one without any place to cut is encoded whole, with some 100 times its size.
    """
    if chunk < 4 * overlap:
        raise ValueError("a chunk must be four overlaps long at least")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    done = [_short(read.filter(F.length("text") <= chunk), tokenizer)]
    long = materialise(read.filter(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text"))
    pending, failed = long, long.count()
    while failed:
        parts = materialise(_encoded(_cut(pending, chunk, overlap), tokenizer, chunk, overlap))
        spliced = materialise(_spliced(parts))
        release(parts)
        done.append(spliced.filter("not failed").select("doc_id", "n_bytes", "n_tokens"))
        pending = long.join(spliced.filter("failed").select("row"), "row", "left_semi")
        failed = spliced.filter("failed").count()
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
    return reduce(DataFrame.unionByName, done).withColumn("over_limit", F.col("n_tokens") > limit)
