"""A corpus pipeline of five operators: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.llm import decontamination, language_id, line_dedup, ngram_join, packing
from unitloom.llm.common import documents, stored
from unitloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (null texts, texts without letters) go; a missing lang becomes the predicted one. Rows are judged one by one, texts whole."""
    d = language_id.identify(docs.select(*COLUMNS), extra=REST).where(F.col("lang_pred") != language_id.UNKNOWN)
    return d.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are equal or similar to earlier ones go; so do documents that lose lines and have no word left: they were copies."""
    d = line_dedup.dedup_lines(docs.select(*COLUMNS)).where((F.size("gone") == 0) | F.col("kept").rlike(r"\S"))
    return d.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (a null id comes first) stays, once if its row repeats."""
    found = ngram_join.near_duplicates(docs)
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark phrase go."""
    d = docs.select(*COLUMNS)
    for part in decontamination.benchmark_parts(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        d = decontamination.occurrences(d, part, extra=REST).where(F.size("spans") == 0).select(*COLUMNS)
    return d


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed into sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language identification and packing have no SQL twin; the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
