"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.collocations import COLLOCATIONS_SQL, collocations
from quillon.llm.exact_dedup import EXACT_SQL, exact_groups
from quillon.llm.html_extraction import extract_main_text
from quillon.llm.importance_resampling import RESAMPLING_SQL, resample
from quillon.llm.lm_scoring import score
from quillon.llm.near_dedup import near_groups
from quillon.llm.packing import pack
from quillon.llm.quality_classifier import score_quality
from quillon.llm.quality_rules import judge
from quillon.llm.source_mixing import mixing_report
from quillon.llm.substring_dedup import remove_repeated_windows
from quillon.llm.suffix_dedup import remove_repeated_strings
from quillon.llm.token_counts import token_counts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(_read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_read(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_source_mixing, op4_quality_rules, op5_html_extraction, op6_exact_dedup, op7_quality_classifier, op8_near_dedup, op9_lm_scoring, op10_packing, op11_collocations, op12_importance_resampling, op13_token_counts)}

#: DuckDB SQL for those that SQL expresses in reasonable time on whole tables.
ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": EXACT_SQL, "op11_collocations": COLLOCATIONS_SQL, "op12_importance_resampling": RESAMPLING_SQL}
