"""One query for each operator: applied to its whole table, with its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import (
    bytespans, decontaminate, extraction, idfile, infill, lines, neardup, packing, quality, ranking, sharding, urls, wordspans)
from tablescope.session import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.id_report(
        _table(spark, sf_dir, "documents"), new_path(spark, "ids"), public_tokenizers.path("word_bpe_49k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extraction_report(_table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytespans.span_report(_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordspans.span_report(_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(_table(spark, sf_dir, "documents"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_id_output": op1_token_id_output,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_sharding": op4_sharding,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_quality_rules": op7_quality_rules,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLES: dict[str, str] = {
    "op5_suffix_array_dedup": bytespans.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "op9_substring_dedup": wordspans.ORACLE,
    "op11_line_dedup": lines.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
    "op13_ranked_lexical_search": ranking.ORACLE,
}
