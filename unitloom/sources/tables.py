"""Sources and sinks: nested JSON records, binary discovery, versioned table sets, and pluggable classifiers and encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Version of a written table set; another version is not read.
VERSION = 1
# fixed values: name endings of files that are no binaries
NOT_BINARY = (".json", ".pkl", ".idb", ".i64", ".id0", ".id1", ".id2", ".nam", ".til", ".txt", ".log", ".c", ".h", ".asm")
FEATURES = "_bb_slice_feature.json"
CASES = "description STRING, num_queries INT, cases ARRAY<STRUCT<cve_id: STRING, library: STRING, vuln_function: STRING, host_function: STRING, inlined_into: STRING, vuln_source: STRING, query_binary: STRING, gt_binary: STRING, gt_addr: STRING, gt_type: STRING>>"
FEATURE = "STRUCT<func_addr: STRING, func_name: STRING, debug_func_name: STRING, pseudocode: STRING, lines: ARRAY<STRUCT<line: STRING, line_index: INT, line_ea: STRING>>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each case of a case file."""
    return spark.read.schema(CASES).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each function of feature files (objects keyed by address); files that do not parse give none."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_path"))
    d = raw.select("file", F.from_json("value", f"MAP<STRING, {FEATURE}>").alias("m")).where(F.col("m").isNotNull())
    return d.select("file", F.explode("m").alias("addr", "f")).select(F.regexp_extract("file", r"([^/]*?)(?:_bb_slice)?_feature\.json$", 1).alias("binary_name"), "addr", "f.*")


def discover_binaries(paths: DataFrame) -> DataFrame:
    """Distinct paths, sorted, of files that are binaries by name and lie in no source tree. paths: (path)."""
    ending = F.lit(False)
    for e in NOT_BINARY:
        ending = ending | F.lower("path").endswith(e)
    return paths.where(~ending & ~F.col("path").rlike(r"_srccode/")).distinct().orderBy("path")


def pool_binaries(files: DataFrame, suffix: str = FEATURES) -> DataFrame:
    """binary_name, feature_path, embedding_path of feature files whose binary lies beside them. files: (root, path), roots in order; of a name the first root wins, there the first path."""
    base = files.where(F.col("path").endswith(suffix)).withColumn("base", F.expr(f"left(path, length(path) - {len(suffix)})"))
    there = files.select(F.col("path").alias("base")).distinct()
    d = base.join(there, "base", "left_semi").withColumn("binary_name", F.regexp_extract("base", r"([^/]*)$", 1))
    w = Window.partitionBy("binary_name").orderBy("root", "path")
    d = d.withColumn("n", F.row_number().over(w)).where("n = 1")
    return d.select("binary_name", F.col("path").alias("feature_path"), F.concat("base", F.lit("_embeddings.pkl")).alias("embedding_path"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written, so that every row has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_results(path: str, metrics: DataFrame, misses: DataFrame, details: DataFrame) -> None:
    """The sinks of an evaluation: recall, what was missed and why, and each query's best results."""
    for name, df in (("metrics", metrics), ("misses", misses), ("details", details)):
        write_json(df, f"{path}/{name}")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A table set with its version; the version is written last, so that a half-written set is never read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION, k) for k in tables], "version int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_meta")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The set at path, None if there is none of this version."""
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.parquet(f"{path}/_meta").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if any(r.version != VERSION for r in meta):
        return None
    return {r.name: spark.read.parquet(f"{path}/{r.name}") for r in meta}


def write_index(path: str, vectors: DataFrame, meta: DataFrame) -> None:
    """Vectors (vec_id, emb) and what they belong to (vec_id, ...); refused unless each vector has one row of meta."""
    have, named = vectors.select("vec_id"), meta.select("vec_id")
    n, m, both = have.count(), named.count(), have.distinct().join(named.distinct(), "vec_id").count()
    if not n == m == both:
        raise ValueError(f"{n} vectors, {m} rows of meta, {both} ids in both")
    write_tables({"vectors": vectors, "meta": meta}, path)


def built_once(spark: SparkSession, path: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The table set at path; where there is none of this version it is built and written first."""
    found = read_tables(spark, path)
    if found is None:
        write_tables(build(), path)
        found = read_tables(spark, path)
    return found


def classified(pairs: DataFrame, classify: Callable[[list[str], list[str]], list[str]]) -> DataFrame:
    """pairs (query_id, func_id, q_text, c_text) with answer, from any classifier of batches; its errors count as no match."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                answers = classify(b.q_text.tolist(), b.c_text.tolist())
            except Exception as e:  # noqa: BLE001  a classifier's failure is an answer that matches nothing
                answers = [f"error: {type(e).__name__}"] * len(b)
            yield b.assign(answer=answers)

    return pairs.repartition("query_id").mapInPandas(work, "query_id long, func_id long, q_text string, c_text string, answer string")


def encoded(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """texts (func_id, text) with emb, from any encoder of batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"func_id": b.func_id, "emb": encode(b.text.fillna("").tolist())})

    return texts.select("func_id", "text").mapInPandas(work, "func_id long, emb array<double>")


def without_gaps(texts: DataFrame, group: str) -> DataFrame:
    """Rows of groups in which no text is empty, but for rows that are known to have none: a group is encoded whole or not at all."""
    gaps = texts.where((F.col("text") == "") & ~F.col("known")).select(group).distinct()
    return texts.join(gaps, group, "left_anti")


def messages(pairs: DataFrame, system: str, shots: tuple[tuple[str, str, str, str], ...] = ()) -> DataFrame:
    """Prompt messages for pairs: the fixed instruction, turns of worked examples (query, candidate, reasoning, label), then both texts."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))

    def pair(q, c):
        return F.concat(F.lit("QUERY:\n"), q, F.lit("\n\nCANDIDATE:\n"), c)

    turns = [t for q, c, why, label in shots for t in (one("user", pair(F.lit(q), F.lit(c))), one("assistant", F.lit(f"{why.rstrip()}\n\nANSWER: {label}")))]
    return pairs.withColumn("messages", F.array(one("system", F.lit(system)), *turns, one("user", pair(F.col("q_text"), F.col("c_text")))))
