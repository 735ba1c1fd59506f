"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, pipelines, retrieval

_MODULES = (retrieval, evaluation, pipelines)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top results of all stages: segmentation to fused scores."""
    return retrieval.top_results(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
