"""Vectorised word spans and fingerprints over UTF-8 buffers (NumPy)."""

from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
import pyarrow as pa

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the worker process.

    Functions pickled by value bring their own copy of a module's globals to each
    task; what is kept there is made anew a task and freed late.
    """
    home = sys.modules.setdefault("_quillon_process_cache", types.ModuleType("_quillon_process_cache"))
    return home.__dict__.setdefault(name, {})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words (splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A fingerprint of two fingerprints in order; not linear, so that no pattern of texts cancels out."""
    return mix(mix(a + _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93) + b)


def runs_of(symbols: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k symbols, by doubling: a run of 2n is a pair of runs of n; the last pair may overlap."""
    h, n = symbols, 1
    while n < k and len(h):
        step = min(n, k - n)
        h = combine(h[:-step], h[step:]) if len(h) > step else h[:0]
        n += step
    return h


#: The prime 2**61 - 1. Texts that differ collide under a random base with a probability of their length / PRIME.
PRIME = (1 << 61) - 1


def _fold(x: np.ndarray) -> np.ndarray:
    """x below 2**64 modulo PRIME."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, by halves of 32 bits."""
    half, part = _U(0xFFFFFFFF), _U((1 << 29) - 1)
    a1, a0, b1, b0 = a >> _U(32), a & half, b >> _U(32), b & half
    mid, low = a1 * b0 + a0 * b1, a0 * b0
    return _fold(((a1 * b1) << _U(3)) + (mid >> _U(29)) + ((mid & part) << _U(32)) + (low & _U(PRIME)) + (low >> _U(61)))


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the seed's base modulo PRIME, and their inverses."""
    known = process_cache("powers")
    have = known.get(seed)
    if have is None or len(have[0]) < n:
        size, base = 1 << max(10, int(n - 1).bit_length()), int(np.random.default_rng(7000 + seed).integers(1 << 32, PRIME))
        out = []
        for b in (base, pow(base, -1, PRIME)):
            a = np.ones(1, _U)
            while len(a) < size:
                a = np.concatenate([a, times(a, np.full(len(a), pow(b, len(a), PRIME), _U))])
            out.append(a)
        have = known[seed] = tuple(out)
    return have[0][:n], have[1][:n]


def byte_fingerprints(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, longest: int, slice_bytes: int = 1 << 19) -> np.ndarray:
    """64-bit fingerprints of buf[start:end], ranges of at most `longest` bytes whose starts ascend.

    A polynomial of the bytes modulo PRIME. Sums of bytes times both halves of the
    powers stay below 2**64 in a slice, so only the ranges' own values are reduced;
    slices overlap by `longest` and may cut a text anywhere.
    """
    out, at = np.empty(len(start), _U), 0
    while at < len(start):
        a = int(start[at])
        to = int(np.searchsorted(start, a + slice_bytes))
        part = buf[a : a + slice_bytes + longest].astype(_U) + _U(1)
        power, inverse = powers(slice_bytes + longest + 1, seed)
        s, e = start[at:to] - a, end[at:to] - a
        sums = []
        for half in (power & _U(0xFFFFFFFF), power >> _U(32)):
            pre = np.zeros(len(part) + 1, _U)
            np.cumsum(part * half[: len(part)], out=pre[1:])
            sums.append(pre[e] - pre[s])
        low, high = sums
        h = _fold(_fold(low) + (high >> _U(29)) + ((high & _U((1 << 29) - 1)) << _U(32)))
        out[at:to] = mix(times(h, inverse[s]) + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))
        at = to
    return out


def distinct_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of ascending ranges that don't overlap: each one's number, and the distinct contents, compared byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    a, b = int(starts[0]), int(ends[-1])
    edge = np.zeros(b - a + 1, np.int8)
    edge[starts - a] += 1
    edge[ends - a] -= 1
    data = buf[a:b][np.cumsum(edge[:-1], dtype=np.int8) > 0]
    offs = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def range_digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each buf[start:end], which may overlap, as two 64-bit halves."""
    view = memoryview(np.ascontiguousarray(buf))
    raw = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def digests(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each value, as two 64-bit halves."""
    raw = b"".join(hashlib.blake2b(v, digest_size=16).digest() for v in values)
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def text_buffer(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes on end, and the n + 1 offsets. A null text is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the range of its words (n + 1 pointers)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def windows(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First items of all runs of k items within one text, and each run's text."""
    n = np.maximum(np.diff(ptr) - (k - 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[:-1], n)
    return at, doc


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
