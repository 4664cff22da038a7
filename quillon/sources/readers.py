"""Readers of the domain's file formats as DataFrames. All parsing happens on the executors.

Not read: HDF5, Zarr and BIOM (HDF5) need libraries that Spark doesn't have; they raise
the same error as any unknown suffix. Remote services are out of scope: land their
responses as files first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.semantics import nan_to_null

SUFFIXES = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "csv": ",", "tsv": "\t", "txt": "\t", "tab": "\t"}


def load(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """By suffix, .gz included; feather through Arrow on the driver, for small files. NaN becomes NULL."""
    parts = path.rstrip("/").lower().split(".")
    kind = parts[-2] if parts[-1] == "gz" and len(parts) > 2 else parts[-1]
    if kind == "feather":
        import pyarrow.feather as feather

        return nan_to_null(spark.createDataFrame(feather.read_table(path).to_pandas()))
    if kind not in SUFFIXES:
        raise ValueError(f"unsupported format .{kind}; supported: {', '.join(sorted([*SUFFIXES, 'feather']))}")
    how = SUFFIXES[kind]
    reader = spark.read.schema(schema) if schema else spark.read
    if how in ("parquet", "orc", "json"):
        return nan_to_null(reader.format(how).load(path))
    reader = reader.option("header", True).option("sep", how).option("nullValue", "").option("nanValue", "NaN")
    return nan_to_null((reader if schema else reader.option("inferSchema", True)).csv(path))


def clinical(spark: SparkSession, path: str, id_name: str = "sample_id") -> DataFrame:
    """A table whose first column is the id."""
    df = load(spark, path)
    return df.withColumnRenamed(df.columns[0], id_name).withColumn(id_name, F.col(id_name).cast("string"))


def numeric_only(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Long genotypes: chrom, pos, id, ref, alt, sample, dosage (NULL where missing)."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError("no #CHROM line")
    samples = head["value"].split("\t")[9:]
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(f.alias("f"))
    pairs = F.arrays_zip(F.array(*map(F.lit, samples)).alias("sample"), F.slice("f", 10, max(1, len(samples))).alias("call"))
    out = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[2].alias("id"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), F.explode(pairs).alias("p"))
    gt = F.split_part(F.col("p")["call"], F.lit(":"), F.lit(1))
    alleles = F.filter(F.split(gt, r"[/|]"), lambda a: a != ".")
    dosage = F.when(F.size(alleles) == 2, F.size(F.filter(alleles, lambda a: a != "0"))).cast("byte")
    return out.select("chrom", "pos", "id", "ref", "alt", F.col("p")["sample"].alias("sample"), dosage.alias("dosage"))


def actigraphy(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, activity) whatever the activity column is called."""
    df = load(spark, path)
    low = {c.lower(): c for c in df.columns}
    names = [low[c] for c in ("activity", "counts", "activity_counts", "axis1", "vm") if c in low]
    time = next((low[c] for c in ("timestamp", "time", "datetime", "date") if c in low), None)
    if not names or time is None:
        raise ValueError("no time or activity column")
    return df.select(F.col(time).cast("timestamp").alias("timestamp"), F.coalesce(*(F.col(c).cast("double") for c in names)).alias("activity"))


def rr_intervals(spark: SparkSession, path: str) -> DataFrame:
    """One interval in milliseconds a line; other lines are skipped."""
    v = spark.read.text(path).select(F.expr("try_cast(trim(split(value, '[,;\\t ]')[0]) AS DOUBLE)").alias("ibi"))
    return v.filter("ibi is not null")


def described_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A tab table whose second line describes the columns: that line's key is no key and is dropped."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    return raw.filter(~F.col(key).rlike(r"(?i)subject|description|identifier|\s"))


def wide_fields(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Columns named field-instance.array as long rows: key, field, instance, item, value."""
    df = spark.read.option("header", True).csv(path)
    cols = [c for c in df.columns if c != key]
    long = df.withColumnsRenamed({c: c.replace(".", "_") for c in cols}).unpivot([key], [c.replace(".", "_") for c in cols], "name", "value").filter("value is not null")
    part = lambda g: F.regexp_extract("name", r"^(\d+)-(\d+)_(\d+)$", g).try_cast("int") if hasattr(Column, "try_cast") else F.regexp_extract("name", r"^(\d+)-(\d+)_(\d+)$", g).cast("int")
    return long.select(key, part(1).alias("field"), part(2).alias("instance"), part(3).alias("item"), "value")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """Lines of name, description, genes: one row a set and gene."""
    f = F.split("value", "\t")
    sets = spark.read.text(path).filter(F.size(f) > 2).select(f[0].alias("set_id"), f[1].alias("description"), F.explode(F.slice(f, F.lit(3), F.size(f))).alias("gene"))
    return sets.withColumn("gene", F.trim("gene")).filter("gene <> ''")


def ontology_terms(spark: SparkSession, path: str) -> DataFrame:
    """[Term] blocks: id, name, synonyms, parents."""
    block = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value").startswith("[Term]"))
    one = lambda tag: F.nullif(F.regexp_extract("value", rf"(?m)^{tag}: (.*)$", 1), F.lit(""))
    many = lambda p: F.regexp_extract_all("value", F.lit(p), F.lit(1))
    return block.select(one("id").alias("id"), one("name").alias("name"), many(r'(?m)^synonym: "([^"]*)"').alias("synonyms"), many(r"(?m)^is_a: (\S+)").alias("parents"))


def scored_links(spark: SparkSession, path: str, least: float, sep: str = " ", scale: float = 1000.0) -> DataFrame:
    """Three columns a, b, score; scores over `scale`, kept from `least` on."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    a, b, s = df.columns[:3]
    return df.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(s).cast("double") / scale).alias("score")).filter(F.col("score") >= least)


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).xml(path)


def comment_table(spark: SparkSession, path: str, comment: str, sep: str = "\t", widths_line: bool = False) -> DataFrame:
    """A table under comment lines; with widths_line its first row (such as 5s 15s) is dropped."""
    df = spark.read.option("header", True).option("sep", sep).option("comment", comment).csv(path)
    return df.filter(~F.col(df.columns[0]).rlike(r"^\d+[sdn]$")) if widths_line else df


def series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long values of a series matrix: feature, sample, value; lines with ! are skipped."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("!") & (F.trim("value") != ""))
    head = lines.filter(F.col("value").rlike('^"?ID_REF')).first()
    if head is None:
        raise ValueError("no ID_REF line")
    samples = [c.strip('"') for c in head["value"].split("\t")[1:]]
    f = F.transform(F.split("value", "\t"), lambda x: F.regexp_replace(x, '^"|"$', ""))
    rows = lines.filter(~F.col("value").rlike('^"?ID_REF')).select(f.alias("f"))
    pairs = F.arrays_zip(F.array(*map(F.lit, samples)).alias("sample"), F.slice("f", 2, max(1, len(samples))).alias("value"))
    return rows.select(F.col("f")[0].alias("feature"), F.explode(pairs).alias("p")).select("feature", "p.sample", F.expr("try_cast(p.value AS DOUBLE)").alias("value"))


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_v", F.row_number().over(w)).filter("_v = 1").drop("_v")
