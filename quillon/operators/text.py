"""Text mining with column functions: mentions, scores, dictionary terms, HTML parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accession patterns of public repositories.
ACCESSIONS = {"geo": r"\bGSE\d{3,8}\b", "sra": r"\b[SED]RP\d{6,9}\b", "bioproject": r"\bPRJ[NED][A-Z]\d{4,8}\b", "dbgap": r"\bphs\d{6}(?:\.v\d+\.p\d+)?\b", "ega": r"\bEGA[SD]\d{11}\b", "arrayexpress": r"\bE-[A-Z]{4}-\d+\b", "metabolights": r"\bMTBLS\d+\b", "openneuro": r"\bds\d{6}\b", "clinical_trial": r"\bNCT\d{8}\b"}
SAMPLE_SIZE = r"(?i)\bn\s*=\s*(\d{2,6})\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def mentions(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """One row a distinct match: key, kind, match."""
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("matches")) for k, p in patterns.items()))
    return df.select(key, F.explode(found).alias("f")).select(key, "f.kind", F.explode("f.matches").alias("match"))


def with_context(df: DataFrame, key: str, text: str, pattern: str, around: int) -> DataFrame:
    """Every match with so many characters on either side."""
    whole = rf"(?s).{{0,{around}}}(?:{pattern}).{{0,{around}}}"
    return df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(whole), F.lit(0))).alias("at", "context"))


def relevance(text: Column, terms: list[str], patterns: list[str], excluded: list[str]) -> Column:
    """Two a term contained and one a pattern met, case-insensitively; zero if an excluded term is there."""
    low = F.lower(text)
    score = sum((low.contains(t.lower()).cast("int") * 2 for t in terms), F.lit(0)) + sum((text.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))
    bad = F.lit(False)
    for t in excluded:
        bad = bad | low.contains(t.lower())
    return F.when(bad, 0).otherwise(score)


def html_links(df: DataFrame, key: str, html: str) -> DataFrame:
    return df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), F.lit(1))).alias("at", "href"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
