"""Collocations, importance resampling and token counts against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import collocations as C
from quillon.llm import importance_resampling as I
from quillon.llm import token_counts as T

LOWER = {c: c + 32 for c in range(65, 91)}


def bag(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def low(t):
    return (t or "").translate(LOWER)


def plain_collocations(rows, longest, least, covered, most):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    best = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(o == lang and len(q) > len(p) and inside(q) and 100 * b >= covered * a for (o, q), b in cand.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        best[lang].append((-score, -a, " ".join(p).encode(), left, right))
    out = collections.Counter()
    for lang, all_of in best.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(all_of)[:most], 1):
            out[lang, rank, p.decode(), -a, left, right, n[lang], -score] += 1
    return out


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("least, most", [(3, 2000), (2, 7)])
def test_collocations(docs, rows, none, least, most):
    got = C.collocations(docs, least=least, most=most)
    assert bag(got, *COLS) == plain_collocations([(r[2], r[1]) for r in rows], 4, least, 80, most)
    assert C.collocations(none, least=least).count() == 0


def test_collocations_ties(spark):
    r = random.Random(3)
    text = lambda: "".join(r.choice(["ab", "Ba", "c", "é", "d d"]) + r.choice([" ", "  ", "\t", " ", ", ", ".\n"]) for _ in range(r.randint(0, 40)))
    rows = [(r.choice(["x", "y", None, "und"]), text()) for _ in range(120)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for longest in (2, 4):
        assert bag(C.collocations(df, max_words=longest, least=5), *COLS) == plain_collocations(rows, longest, 5, 80, 2000)


def test_collocation_slices(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 10)
    raw = b"aa bb, cc dd ee ff gg hh ii. j\n" + b"k" * 9000 + b"! l"
    parts = [bytes(p) for p in C._slices(np.frombuffer(raw, np.uint8))]
    assert b"".join(parts) == raw and len(parts) == 3
    assert all(p[-1:] in b".,;:!?\n" for p in parts[:-1])


def plain_resampling(rows, target, longest, buckets, percent, least):
    def features(text):
        w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for d, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 60)])
def test_resampling(spark, docs, rows, none, longest, percent):
    target = [rows[3][1], "hello world 42", None, "", "É é Abc"]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain_resampling([(r[0], r[1]) for r in rows], target, longest, 500, percent, 20)
    got = I.resample(docs, df, max_n=longest, buckets=500, percent=percent)
    assert bag(got, "doc_id", "n_features", "weight", "score", "rank") == want
    assert I.resample(none, df).count() == 0
    assert bag(I.resample(docs, df.limit(0), buckets=50), "doc_id", "n_features", "weight", "score", "rank") == plain_resampling([(r[0], r[1]) for r in rows], [], 1, 50, 10, 20)


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def awkward_texts(n, size, seed=1):
    r = random.Random(seed)
    bits = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "é", "ñandú", "'ll", "'", "'s", "'r", "12", "٣", "²", "!?", "<|endoftext|>", "<|endof", "text|>", "日本", "😀", "é", "​", "\0", "aaaaaaaaaaaaaaaa", "xyz"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_units(vocabulary, plain):
    texts = awkward_texts(3000, 30)
    assert T.Counter(vocabulary).count(pa.array(texts)).tolist() == [plain(t) for t in texts]


def test_token_counts(spark, docs, rows, none, vocabulary, plain):
    want = collections.Counter((r[0], len((r[1] or "").encode()), plain(r[1]), plain(r[1]) > 512) for r in rows)
    for chunk, overlap in ((8192, 256), (400, 60), (100, 24)):
        assert bag(T.token_counts(docs, vocabulary, chunk=chunk, overlap=overlap), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert T.token_counts(none, vocabulary).count() == 0


def test_resynchronisation(spark, vocabulary, plain):
    """Texts whose overlaps hold no common place, whole runs, and special strings that chunks cut."""
    texts = awkward_texts(200, 120, 2) + ["z" * 3000 + " end", " " * 2000 + "x", "<|endoftext|>" * 90, "ab " * 20 + "q" * 500 + " cd" * 300, "I'll" * 300, "é" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = collections.Counter((i, len(t.encode()), plain(t)) for i, t in enumerate(texts))
    for chunk, overlap in ((64, 16), (150, 30)):
        assert bag(T.token_counts(df, vocabulary, chunk=chunk, overlap=overlap), "doc_id", "n_bytes", "n_tokens") == want


def test_tokenizers_that_cannot_be_cut(vocabulary):
    with pytest.raises(ValueError):
        T.Counter(vocabulary.replace("byte_bpe_50k", "word_bpe_49k"))
