"""Importance resampling of documents towards the distribution of target texts.

DuckDB runs in each task over the task's own rows: SQL unnests the words, windows
them into runs, and counts these by bucket with a registered CRC function. One row
of bucket counts a document goes to Parquet in the shared folder; Spark merges
these to the two distributions, scores every document by them and draws without
replacement by the Gumbel top-k rule.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._shared import bounded_batches, materialise

#: Bytes of text that one SQL statement takes; DuckDB holds some 40 times as much.
SLICE_BYTES = 4 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTED = "row long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def _crc(words: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.uint64())


def count_sql(max_n: int, buckets: int) -> str:
    """Bucket counts of each row of `batch` (row, doc_id, text)."""
    window = "OVER (PARTITION BY row ORDER BY pos)"
    runs = ["SELECT row, word AS feature FROM words"]
    for n in range(2, max_n + 1):
        feature = " || ' ' || ".join(["word", *(f"lead(word, {j}) {window}" for j in range(1, n))])
        runs.append(f"SELECT row, feature FROM (SELECT row, {feature} AS feature FROM words) WHERE feature IS NOT NULL")
    return f"""
        WITH words AS (
          SELECT row, unnest(w) AS word, unnest(range(len(w))) AS pos
          FROM (SELECT row, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM batch)
        ), runs AS ({" UNION ALL ".join(runs)}),
        counted AS (SELECT row, feature, count(*) AS c FROM runs GROUP BY ALL),
        hashed AS (SELECT feature, (crc_of(feature) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT feature FROM counted)),
        merged AS (SELECT row, bucket, sum(c)::BIGINT AS c FROM counted JOIN hashed USING (feature) GROUP BY ALL),
        listed AS (SELECT row, sum(c)::BIGINT AS n_features, list(bucket ORDER BY bucket) AS buckets, list(c ORDER BY bucket) AS counts FROM merged GROUP BY row),
        sized AS (SELECT row, count(*) AS n_words FROM words GROUP BY row)
        SELECT batch.row, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(buckets, []::INTEGER[]) AS buckets, coalesce(counts, []::BIGINT[]) AS counts
        FROM batch LEFT JOIN sized USING (row) LEFT JOIN listed USING (row)"""


def bucket_counts(docs: DataFrame, max_n: int, buckets: int, id_col: str | None, text_col: str) -> DataFrame:
    """One row of bucket counts a row of docs, as a table in the shared folder; `row` numbers the rows."""

    def counted(batches):
        import duckdb
        from pyspark import TaskContext

        con = duckdb.connect(config={"threads": 1})
        con.execute("SET temp_directory = ''")
        con.create_function("crc_of", _crc, ["VARCHAR"], "UBIGINT", type="arrow")
        sql, row = count_sql(max_n, buckets), TaskContext.get().partitionId() << 33
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
                part = batch.slice(at, end - at)
                con.register("batch", pa.table({"row": pa.array(np.arange(row, row + part.num_rows)), "doc_id": part.column(0), "text": part.column(1)}))
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("batch")
                row, at = row + part.num_rows, end
        con.close()

    ids = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    read = bounded_batches(docs).select(ids.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialise(read.mapInArrow(counted, _COUNTED))


def _totals(counted: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket; the driver gets one row a bucket."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("c"))
    out = [0] * buckets
    for bucket, c in pairs.collect():
        out[bucket] = c
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of the target's smoothed share over the source's) by bucket."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source, target, strict=True)]


def numbered(df: DataFrame, order: list) -> DataFrame:
    """df with `place` from 1 on in an order without ties, by ranges: no task gets all rows. A table in the shared folder."""
    at = materialise(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = sorted(at.groupBy("range").count().collect())  # one row a range
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "range int, before long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return at.withColumn("within", within).join(F.broadcast(starts), "range").withColumn("place", F.col("before") + F.col("within")).drop("range", "within", "before")


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank (from 1 among the drawn, else null).

    Features are the runs of 1 to max_n words; weight is the sum of their buckets' gains, score adds Gumbel noise
    from the id, so the floor(percent * N / 100) highest scores of the N rows with least_words words are a sample by
    importance without replacement. Equal scores go to the smaller id (null ids last, with one noise), then to
    the row read first: repeated rows are drawn one by one. Null and empty texts have no features, weight 0 and no
    rank; an empty target gives gains from smoothing alone; an empty table gives no rows; other columns, whatever
    their names, are ignored. A batch of long texts is counted in slices; one text is held whole, with some 40
    times its size.
    """
    counted = bucket_counts(docs, max_n, buckets, id_col, text_col)
    gain = np.array(gains(_totals(counted, buckets), _totals(bucket_counts(target, max_n, buckets, None, target_col), buckets)), np.int64)

    def weighed(batches):
        for batch in batches:
            which, counts = batch.column("buckets"), batch.column("counts")
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[which.flatten().to_numpy()] * counts.flatten().to_numpy())])
            ends = np.cumsum(pc.list_value_length(which).to_numpy(zero_copy_only=False)).astype(np.int64)
            weight = sums[ends] - sums[np.concatenate([np.zeros(1, np.int64), ends[:-1]])] if len(ends) else ends
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_words", "n_features")), pa.array(weight, pa.int64())], names=["row", "doc_id", "n_words", "n_features", "weight"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = counted.mapInArrow(weighed, "row long, doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)
    fits = F.col("n_words") >= least_words
    drawn = counted.filter(fits).count() * percent // 100
    ranked = numbered(scored.filter(fits), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")])
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).select(out).unionByName(scored.filter(~fits).withColumn("rank", F.lit(None).cast("long")).select(out))


#: The same for DuckDB, with the operator's defaults. The table of CRC-32 and its steps are spelt out by lists.
RESAMPLING_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), each AS (SELECT doc_id, unnest(w) AS word FROM doc_words),
vocabulary AS (SELECT word, hex(word) AS h FROM (SELECT word FROM each UNION SELECT word FROM target_words)),
hashed AS (
  SELECT word, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000) AS bucket
  FROM vocabulary, crc_table
), s AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM s)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + 10000 FROM t)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), weighed AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM each JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc_words LEFT JOIN weighed USING (doc_id)
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed
"""
