"""Collocations: phrases of a language whose parts rarely occur without each other.

All runs of 1 to max_words words are exploded into rows, level by level, and
counted by language and phrase in one hash aggregate a level. A phrase that occurs
`least` times has parts that do, so a level emits only the runs whose two parts of
one word less are in a bitmap of the frequent phrases of the level before. The
bitmap has a bounded size and no false negatives: what it lets through in error is
counted exactly and falls below `least` then.

Candidates are joined with the counts of their prefixes and suffixes, scored in
Decimal, rid of those that a phrase one word longer stands for, and ranked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import _hashing as H
from quillon.llm._shared import bounded_batches, materialise, release

#: Bytes of text whose runs are counted at once; their arrays take some 60 times as much.
SLICE_BYTES = 2 << 20
#: A bitmap has 2**LEAST_BITS to 2**MOST_BITS bits (128 MB), and 32 a frequent phrase between these.
LEAST_BITS, MOST_BITS = 16, 30
#: Bytes of a bitmap in one row.
_CHUNK = 1 << 14

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in ".,;:!?"]] = True
_SEPARATOR[0x0A:0x0E] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True

_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _salt(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def _slices(buf: np.ndarray) -> Iterator[np.ndarray]:
    """buf in parts of some SLICE_BYTES, cut after a separator: no run of words crosses one."""
    at = 0
    while at < len(buf):
        end = min(at + SLICE_BYTES, len(buf))
        step = 1 << 12
        while end < len(buf) and not _SEPARATOR[buf[end - 1]]:  # a piece without separators stays whole
            ahead = np.flatnonzero(_SEPARATOR[buf[end : end + step]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + step, len(buf))
            step *= 2
        yield buf[at:end]
        at = end


class Pieces:
    """The words of a buffer: numbers of distinct ones, their strings, fingerprints and pieces."""

    def __init__(self, buf: np.ndarray):
        cut = _SEPARATOR[buf]
        word = ~(cut | _BLANK[buf])
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.piece = np.cumsum(cut, dtype=np.int32)[starts]
        self.which, values = H.distinct_ranges(buf, starts, ends)
        self.words = pa.array(values, pa.binary()).cast(pa.string())
        raw = b"".join(hashlib.blake2b(v, digest_size=8).digest() for v in values)
        self.prints = np.frombuffer(raw, np.uint64)[self.which]

    def runs(self, n: int) -> np.ndarray:
        """First words of the runs of n words within one piece."""
        m = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[: max(m, 0)] == self.piece[n - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def fingerprints(self, n: int, salt: np.uint64) -> np.ndarray:
        """Of the n words from each word on, in a language."""
        h = self.prints
        for k in range(1, n):
            h = H.combine(h[:-1], self.prints[k:])
        return H.mix(h ^ salt)

    def count(self, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases among the runs of n words at `at`, and how often each occurs."""
        key, size = self.which[at], max(1, len(self.words))
        for k in range(1, n):
            _, key = np.unique(key, return_inverse=True)
            key = key * size + self.which[at + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        chosen = at[first]
        parts = [self.words.take(pa.array(self.which[chosen + k])) for k in range(n)]
        return (pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]), counts


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Slices of the lower-cased texts of each language."""
    table = pa.Table.from_batches([batch])
    langs = table.column(0).combine_chunks()
    for lang in langs.unique().to_pylist():
        texts = table.column(1).filter(pc.equal(langs, lang)).combine_chunks().cast(pa.large_string())
        ended = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        buf, _ = H.text_buffer(ended)
        for part in _slices(buf):
            yield lang, H.lower_ascii(part)


def _level(docs: DataFrame, n: int, bitmap) -> DataFrame:
    """(lang, phrase, f): counts of the runs of n words; for n = 1 also a null phrase that counts all words.

    bitmap: the broadcast bits of the frequent phrases of n - 1 words, as a power of two of them.
    """

    def exploded(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        shift = None if bits is None else np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        for batch in batches:
            for lang, buf in _by_language(batch):
                p = Pieces(buf)
                at = p.runs(n)
                if bits is not None and len(at):
                    where = p.fingerprints(n - 1, _salt(lang)) >> shift
                    known = (bits[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8)) & 1
                    at = at[(known[at] & known[at + 1]) > 0]
                if not len(at):
                    continue
                phrases, counts = p.count(at, n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases, pa.array(counts, pa.int64())], schema=_COUNT)
                if n == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([len(at)], pa.int64())], schema=_COUNT)

    return docs.mapInArrow(exploded, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(frequent: DataFrame, n: int) -> bytes:
    """Bits at the fingerprints of frequent phrases of n words, ORed in tasks; the driver gets at most 2**MOST_BITS."""
    power = min(MOST_BITS, max(LEAST_BITS, (32 * frequent.count()).bit_length()))

    def marked(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in table.column(0).unique().to_pylist():
                phrases = table.column(1).filter(pc.equal(table.column(0), lang)).combine_chunks().cast(pa.large_string())
                buf, _ = H.text_buffer(pc.binary_join_element_wise(phrases, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
                p = Pieces(buf)
                where = p.fingerprints(n, _salt(lang))[p.runs(n)] >> np.uint64(64 - power)
                where = np.unique(where).astype(np.int64)
                chunk = where // (8 * _CHUNK)
                for c in np.unique(chunk).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([_packed(where[chunk == c] - c * 8 * _CHUNK)], pa.binary())], names=["chunk", "bits"])

    def merged(table):
        bits = reduce(np.bitwise_or, (np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()))
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((1 << power) // 8, np.uint8)
    rows = frequent.select("lang", "phrase").mapInArrow(marked, "chunk int, bits binary").groupBy("chunk").applyInArrow(merged, "chunk int, bits binary")
    for row in rows.toLocalIterator():
        at = row["chunk"] * _CHUNK
        part = np.frombuffer(row["bits"], np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out.tobytes()


def _packed(bits: np.ndarray) -> bytes:
    out = np.zeros(8 * _CHUNK, np.uint8)
    out[bits] = 1
    return np.packbits(out, bitorder="little").tobytes()


def phrase_counts(docs: DataFrame, max_words: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, f, words): all phrases of up to max_words words that occur `least` times in their language.

    A row with a null phrase counts all words of its language. The result is a table in the shared folder.
    """
    spark = docs.sparkSession
    texts = bounded_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    levels, bitmap = [], None
    for n in range(1, max_words + 1):
        level = materialise(_level(texts, n, bitmap).filter((F.col("f") >= least) | F.col("phrase").isNull()).withColumn("words", F.lit(n)))
        levels.append(level)
        if bitmap is not None:
            bitmap.destroy()
        if n < max_words:
            bitmap = spark.sparkContext.broadcast(_bitmap(level.filter("phrase is not null"), n))
    out = materialise(reduce(DataFrame.unionByName, levels))
    release(*levels)
    return out


def collocations(docs: DataFrame, max_words: int = 4, least: int = 30, scale: int = 2_000_000, covered: int = 80, most: int = 2000, salts: int = 16, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The `most` best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words at blanks and tabs.
    A phrase of 2 to max_words words is a candidate if it occurs `least` times within pieces. Its score is the
    lowest of floor(scale * a / (l + r)) over its cuts, ties to the earliest cut. It goes if a phrase that
    contains it, with one word more, has at least `covered` percent of its occurrences; a phrase with more words
    implies one with one more. Ties of score go to the larger a, then to the smaller phrase by bytes.

    A null language counts as `und`, a null or empty text has no words; rows are counted as often as they occur;
    ids and other columns, whatever their names, are ignored; an empty table gives no rows. A text of any length is
    counted in slices of SLICE_BYTES; only a piece without separators is held whole, with some 60 times its size.
    """
    counts = phrase_counts(docs, max_words, least, lang_col, text_col)
    total = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    known = counts.filter("phrase is not null")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cand = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = lambda side, f: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = scored.withColumn("divided", exact("a") * F.lit(scale).cast("decimal(18,0)")).withColumn("by", exact("l") + exact("r")).withColumn("score", F.expr("divided div by"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = cand.filter("words > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = lowest.join(longer, (lowest["lang"] == longer["lang"]) & (lowest["phrase"] == longer["phrase"]) & (exact("f") * 100 >= exact("a") * covered), "left_anti")
    kept = kept.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= most)
    ranked = salted.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same for DuckDB, with the operator's defaults.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (SELECT lang, words, phrase, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, words, w, unnest(range(1, words)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, p.f AS l, s.f AS r, ((2000000::HUGEINT * c.a) // (p.f::HUGEINT + s.f))::BIGINT AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f s ON s.lang = c.lang AND s.phrase = array_to_string(c.w[c.k + 1:c.words], ' ')
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([array_to_string(w[1:words - 1], ' '), array_to_string(w[2:words], ' ')]) AS phrase, a FROM cand WHERE words > 2),
kept AS (
  SELECT * FROM lowest o WHERE NOT EXISTS (SELECT 1 FROM longer e WHERE e.lang = o.lang AND e.phrase = o.phrase AND e.a::HUGEINT * 100 >= o.a::HUGEINT * 80)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
