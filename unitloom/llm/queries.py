"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, language_id, line_dedup, ngram_join, oracle, packing, suffix_dedup, token_records, url_filters
from .common import documents
from .secret_scan import secret_report


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=1)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    return url_filters.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_url_filters": op8_url_filters,
    "op9_token_records": op9_token_records,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": oracle.NGRAM_JOIN,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_secret_scan": oracle.SECRET_SCAN,
    "op6_decontamination": oracle.DECONTAMINATION,
    "op8_url_filters": oracle.URL_FILTERS,
    "op10_suffix_dedup": oracle.SUFFIX_DEDUP,
}
