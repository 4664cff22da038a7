"""Writers: files by suffix, upserts by key, checkpointed stages."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITERS = {"parquet": lambda w, p: w.parquet(p), "csv": lambda w, p: w.option("header", True).csv(p), "tsv": lambda w, p: w.option("header", True).option("sep", "\t").csv(p), "json": lambda w, p: w.json(p), "orc": lambda w, p: w.orc(p)}


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by suffix; the error lists what is supported."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in WRITERS:
        raise ValueError(f"unsupported format .{kind}; supported: {', '.join(sorted(WRITERS))}")
    WRITERS[kind](df.write.mode(mode), path)


def upsert(rows: DataFrame, key: list[str], recency: list[str], replace: bool = True) -> DataFrame:
    """One row a key: the latest (replace) or the earliest (ignore). An aggregate, so partial before the shuffle."""
    pick = F.max_by if replace else F.min_by
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*recency)).alias("_r")).select(*key, "_r.*")


class Stages:
    """A folder of stages as Parquet with a manifest; a stage that is done is read, not run again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def run(self, name: str, make) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self.done(name):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def write_report(rows: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A bounded table as Markdown, HTML or JSON by suffix. Over `most` rows are an error: they belong in save()."""
    got = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"over {most} rows: use save()")
    cols, out = rows.columns, Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    if out.suffix == ".json":
        text = json.dumps({"title": title, "rows": got}, indent=2, default=str)
    elif out.suffix == ".html":
        from html import escape

        cell = lambda tag, v: f"<{tag}>{escape(str(v))}</{tag}>"
        text = f"<h1>{escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in cols)}</tr>" + "".join(f"<tr>{''.join(cell('td', r[c]) for c in cols)}</tr>" for r in got) + "</table>"
    elif out.suffix == ".md":
        text = f"# {title}\n\n|{'|'.join(cols)}|\n|{'--|' * len(cols)}\n" + "".join(f"|{'|'.join(str(r[c]) for c in cols)}|\n" for r in got)
    else:
        raise ValueError("supported reports: .md, .html, .json")
    out.write_text(text)
