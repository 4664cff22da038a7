"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so, each chunk is reduced to a digest, and
only digests travel. Chunks are deduplicated to identifiers that are verified by
a second, independent digest and the length; two texts are equal when their
ordered identifier lists are. Long texts thus never move between machines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _hashing as H
from quillon.llm._shared import bounded_batches, materialise

_RECIPE = "doc_id long, text_sha256 string, chunks array<struct<digest:binary,check:binary,length:int>>"

_STEP = 10_000


def normalise_space(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; the ends aren't trimmed."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if H.SPACE[text[0]] else b"") + b" ".join(words) + (b" " if H.SPACE[text[-1]] else b"")


def chunk_ends(text: bytes, mean: int) -> list[int]:
    """Cuts after those 8-byte strings whose fingerprint is a multiple of `mean`; always at the end."""
    n = len(text)
    if n < 9:
        return [n]
    grams = np.ndarray((n - 7,), "<u8", text, strides=(1,))
    cut = np.flatnonzero(H.mix(grams * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(mean) == 0) + 8
    ends = cut.tolist()
    return ends if ends and ends[-1] == n else [*ends, n]


def exact_groups(docs: DataFrame, mean_chunk: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after turning each white-space run into one
    space; null counts as empty. Of equal texts the row with the smallest id stays;
    a null id stays only if all are null, and of repeated rows one stays. An empty
    table gives an empty result; other columns, whatever their names, are ignored. A
    text is held whole by one task, with about 4 times its size.
    """

    def recipes(batches):
        for batch in batches:
            buf, offs = H.text_buffer(batch.column(1))
            raw, digests, chunks = buf.tobytes(), [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                text, own, start = normalise_space(raw[a:b]), [], 0
                digests.append(hashlib.sha256(text).hexdigest())
                for end in chunk_ends(text, mean_chunk):
                    piece = text[start:end]
                    own.append({"digest": hashlib.sha256(piece).digest(), "check": hashlib.blake2b(piece, digest_size=16).digest(), "length": end - start})
                    start = end
                chunks.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(chunks, pa.list_(pa.struct([("digest", pa.binary()), ("check", pa.binary()), ("length", pa.int32())])))], names=["doc_id", "text_sha256", "chunks"])

    read = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows that agree in id and text are one entry with a count.
    entry = materialise(read.mapInArrow(recipes, _RECIPE).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"), F.first("chunks").alias("chunks")))
    placed = entry.select(F.explode("chunks").alias("chunk")).select("chunk.*")
    known = placed.groupBy("digest").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.min("length").alias("short"), F.max("length").alias("long"))
    # A digest that stands for one content is its identifier; with the others (none is known to exist) goes the check.
    doubtful = materialise(known.filter("low <> high or short <> long").select("digest"))
    whole = F.transform("chunks", lambda c: c["digest"])
    recipe = entry.withColumn("recipe", whole)
    if not doubtful.isEmpty():
        torn = entry.select("doc_id", "text_sha256", F.explode("chunks").alias("chunk")).join(doubtful, F.col("chunk.digest") == doubtful["digest"], "left_semi").select("doc_id", "text_sha256").distinct()
        apart = F.transform("chunks", lambda c: F.concat(c["digest"], c["check"], F.encode(c["length"].cast("string"), "UTF-8")))
        same = F.col("doc_id").eqNullSafe(F.col("torn_id")) & (F.col("text_sha256") == F.col("torn_sha"))
        recipe = entry.join(torn.select(F.col("doc_id").alias("torn_id"), F.col("text_sha256").alias("torn_sha"), F.lit(True).alias("torn")), same, "left").withColumn("recipe", F.when(F.col("torn"), apart).otherwise(whole))
    group = recipe.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("entries"))
    # Groups of over a 500th of all entries are fewer than 500 rows: their members are met where they are.
    most = entry.count() // 500
    hot = group.filter(F.col("entries") > most).select(F.col("recipe").alias("hot_recipe"), F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    met = recipe.join(F.broadcast(hot), F.col("recipe") == F.col("hot_recipe"), "left")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256", "copies"]
    rest = met.filter("hot_size is null").select("doc_id", "text_sha256", "copies", "recipe").join(group.filter(F.col("entries") <= most), "recipe").select(*columns)
    one = met.filter("hot_size is not null").select("doc_id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "text_sha256", "copies").unionByName(rest)
    # A row for each copy, in two steps, so that no array is long.
    step = F.lit(_STEP)
    each = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("copies") - 1) / step).cast("long")))).withColumn("copy", F.explode(F.sequence(F.col("part") * step, F.least(F.col("copies"), (F.col("part") + 1) * step) - 1)))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_groups() keeps, with all their columns, whatever their names.

    A null text counts as empty, null ids as larger than others; of repeated rows one stays; an empty table gives an empty
    result. Ids are looked up where the rows are, against those that go; whole rows move only if their id is null or
    repeats, or if those ids are too many to broadcast.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col)
    verdict = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum(F.col("kept").cast("long")).alias("stay"))
    # Ids that go, and those that don't name one row: the latter's rows are told apart by their texts.
    other = materialise(verdict.filter("doc_id is null or times <> 1 or stay <> 1"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("k"))
    found = own.filter("k is not null").join(other.select("doc_id"), F.col("k") == F.col("doc_id"), "left_anti").select("row")
    odd = other.filter("doc_id is null or times > 1").select("doc_id")
    if not odd.isEmpty():
        keys = lambda i: (F.coalesce(i, F.lit(0)).alias("k"), i.isNull().alias("none"))
        stays = groups.filter("kept").select(*keys(F.col("doc_id")), F.col("text_sha256").alias("sha"))
        text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
        digest = F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), 256)
        some = own.filter("k is null").unionByName(own.join(odd, F.col("k") == F.col("doc_id"), "left_semi")).select("row", *keys(F.col("k")), digest.alias("sha"))
        found = found.unionByName(some.dropDuplicates(["k", "none", "sha"]).join(stays, ["k", "none", "sha"], "left_semi").select("row"))
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""
