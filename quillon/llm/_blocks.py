"""Questions of blocks of documents to buckets of keys, and the answers' way back.

A block holds a few MB of whole texts. It reduces the keys it asks about to
distinct ones and sends each bucket (a range of key values) one packed payload;
the bucket merges all payloads and returns one packed reply a block. A key that
occurs in a third of all documents thus costs one entry a block, and buckets are
even because keys are fingerprints. The rows exchanged never outnumber the keys.

The blocks' exchange occurs several times in one plan; Spark runs it once and
reuses it. All is lineage: a lost executor's part is computed again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
#: Entries that a bucket merges at once, for inputs up to 2**40 bytes; with its temporary arrays, under 200 MB.
BUCKET_ENTRIES = 1_000_000

PAYLOAD = "block int, phase int, bucket int, payload binary"
PAYLOAD_ARROW = pa.schema([("block", pa.int32()), ("phase", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def sized(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(doc_id, text, block) with evenly dealt blocks; the number of blocks; the bytes of all texts.

    Rows, not ids, are dealt out, so that any number of rows with one id, or none, spreads.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    size = max(block_bytes, int(block_bytes * math.sqrt(total / (1 << 40))))
    n = max(1, min(math.ceil(total / size), rows))
    key = F.xxhash64("doc_id", F.length("text"))
    return docs.withColumn("block", F.pmod(key, F.lit(n)).cast("int")), n, total


def buckets(entries: float, blocks: int) -> int:
    """So many buckets for all blocks' entries; beyond 2**18 blocks they grow with the blocks' size."""
    return max(1, math.ceil(entries / BUCKET_ENTRIES / max(1, blocks / (1 << 18))))


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """n + 1 pointers into sorted 64-bit keys: a bucket is a range of equal width."""
    edges = [min((i * (1 << 64) + n - 1) // n, (1 << 64) - 1) for i in range(n)]
    at = np.searchsorted(keys, np.array(edges, np.uint64))
    at[0] = 0
    return np.append(at, len(keys))


def rows(block: int, phase: int, payloads: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array([block] * len(payloads), pa.int32()), pa.array([phase] * len(payloads), pa.int32()), pa.array([b for b, _ in payloads], pa.int32()), pa.array([p for _, p in payloads], pa.binary())],
        schema=PAYLOAD_ARROW,
    )


def replies(table: pa.Table, phase: int) -> list[tuple[int, bytes]]:
    """A block's replies of one phase, in the order of buckets."""
    return sorted((b, p) for b, f, p in zip(*(table.column(c).to_pylist() for c in ("bucket", "phase", "payload")), strict=True) if f == phase)


def bits(parts: list[tuple[int, bytes]], counts: np.ndarray) -> np.ndarray:
    """Packed bits of each bucket's reply as one boolean array; counts: entries of each bucket."""
    by = dict(parts)
    out = [np.unpackbits(np.frombuffer(by[b], np.uint8), count=int(n)).astype(bool) for b, n in enumerate(counts) if n]
    return np.concatenate(out) if out else np.zeros(0, bool)


def pack_gaps(values: np.ndarray) -> bytes:
    """Sorted distinct integers as gaps of 1 to 15 half bytes, with a longer form for rare large gaps."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    first, gaps = int(gaps[0]), gaps[1:]
    mean = int(gaps.mean()) if len(gaps) else 1
    width = min(15, max(1, -(-(mean * 8).bit_length() // 4)))
    top = np.uint64((1 << (4 * width)) - 1)
    big = np.flatnonzero(gaps >= top)
    small = np.minimum(gaps, top).astype("<u8")
    whole = np.ascontiguousarray(small.view(np.uint8).reshape(-1, 8)[:, : width // 2]).tobytes()
    if width % 2:  # two gaps' highest half bytes make a byte
        high = np.append((small >> np.uint64(4 * (width - 1))).astype(np.uint8), np.zeros(len(small) % 2, np.uint8)).reshape(-1, 2)
        whole += (high[:, 0] | high[:, 1] << 4).astype(np.uint8).tobytes()
    return np.array([first, len(gaps), width, len(big)], np.uint64).tobytes() + big.astype(np.uint64).tobytes() + gaps[big].astype(np.uint64).tobytes() + whole


def unpack_gaps(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    first, n, width, big = (int(x) for x in np.frombuffer(raw, np.uint64, 4))
    at = np.frombuffer(raw, np.uint64, big, 32).astype(np.int64)
    val = np.frombuffer(raw, np.uint64, big, 32 + 8 * big)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : width // 2] = np.frombuffer(raw, np.uint8, n * (width // 2), 32 + 16 * big).reshape(n, width // 2)
    if width % 2:
        pairs = np.frombuffer(raw, np.uint8, (n + 1) // 2, 32 + 16 * big + n * (width // 2))
        wide[:, width // 2] = np.stack([pairs & 15, pairs >> 4], 1).reshape(-1)[:n]
    gaps = wide.view("<u8").reshape(-1).astype(np.uint64)
    gaps[at] = val
    return np.cumsum(np.concatenate([np.array([first], np.uint64), gaps]), dtype=np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers that may repeat: a gap code of the distinct ones, and which come again."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    again = np.flatnonzero(~new).astype(np.int64).tobytes()
    return len(again).to_bytes(8, "little") + again + pack_gaps(values[new])


def unpack_sorted(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    again, values = np.frombuffer(raw, np.int64, n // 8, 8), unpack_gaps(raw[8 + n :])
    new = np.ones(len(values) + len(again), bool)
    new[again] = False
    return values[np.cumsum(new) - 1]


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of two bits each, with longer forms from 3 and from 255 on."""
    some, big = counts[counts >= 3], counts[counts >= 255]
    small = np.minimum(np.append(counts, np.zeros(-len(counts) % 4, counts.dtype)), 3).astype(np.uint8).reshape(-1, 4)
    quads = small[:, 0] | small[:, 1] << 2 | small[:, 2] << 4 | small[:, 3] << 6
    return np.array([len(counts), len(some), len(big)], np.int64).tobytes() + big.astype(np.int64).tobytes() + np.minimum(some, 255).astype(np.uint8).tobytes() + quads.astype(np.uint8).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    n, some, big = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    more = np.frombuffer(raw, np.uint8, some, 24 + 8 * big).astype(np.int64)
    more[more == 255] = np.frombuffer(raw, np.int64, big, 24)
    quads = np.frombuffer(raw, np.uint8, offset=24 + 8 * big + some)
    out = (quads[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1)[:n].astype(np.int64)
    out[out == 3] = more
    return out


def join(*parts: bytes) -> bytes:
    """Parts on end, each with its length; split() takes them apart."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def sketch_rows(block: int, phase: int, slots: np.ndarray, counts: np.ndarray, cut: np.ndarray) -> pa.Table:
    """One payload a bucket: its slots as gaps, and whether each was met more than once."""
    out = []
    for b in range(len(cut) - 1):
        if cut[b + 1] > cut[b]:
            s = slice(cut[b], cut[b + 1])
            out.append((b, join(pack_gaps(slots[s]), np.packbits(counts[s] > 1).tobytes())))
    return rows(block, phase, out)


def merge_sketches(table: pa.Table) -> pa.Table:
    """Replies for a bucket of sketch_rows(): a bit for each slot, whether it was met more than once in all."""
    parts = [split(p) for p in table.column("payload").to_pylist()]
    slot = [unpack_gaps(p[0]) for p in parts]
    seen, back, count = np.unique(np.concatenate(slot), return_inverse=True, return_counts=True)
    for s, p in zip(slot, parts, strict=True):
        count[np.searchsorted(seen, s)] += np.unpackbits(np.frombuffer(p[1], np.uint8), count=len(s))
    repeated, ends = (count > 1)[back], np.cumsum([len(s) for s in slot])
    return answered(table, [np.packbits(repeated[e - len(s) : e]).tobytes() for e, s in zip(ends, slot, strict=True)])


def answered(table: pa.Table, payloads: list[bytes]) -> pa.Table:
    """The questions' rows with answers for payloads."""
    return table.set_column(table.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal keys: the first row of each group in sorted order, all rows' groups, and the groups' sizes."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    return first, group, np.bincount(group, minlength=len(first))
