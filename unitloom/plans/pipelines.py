"""Queries that SQL does not express: training, sources and sinks, pluggable models. Checked by rows and by their tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_label
from ..functions.vectors import normalized
from ..operators import retrieval as R
from ..operators import training
from ..sources import tables
from ..sources.views import Views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


@query("m05_pca_transform")
def m05(spark: SparkSession, d: str) -> DataFrame:
    return training.transform(Views(spark, d).units(), 16).select("func_id", "pos", F.transform("emb", lambda x: F.round(x, 5)).alias("emb"))


@query("m06_m07_trained_index")
def m06(spark: SparkSession, d: str) -> DataFrame:
    """Units in the buckets of trained centroids, as many and from as many vectors as the number of units asks for."""
    u = Views(spark, d).units()
    n = u.count()
    nlist, _ = training.resolve_nlist(n)
    c = training.centroids(u, min(nlist, max(1, n // 2)), training.train_size(n, nlist))
    return R.nearest(u.select("func_id", "pos", "emb"), ["func_id", "pos"], c, "bucket_id", 3)


@query("m08_resolved_nlist", """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 END AS explicit, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS known FROM documents WHERE doc_id < 60),
a AS (SELECT *, (SELECT count(*) FROM documents) * (doc_id + 1) AS n FROM n)
SELECT doc_id, coalesce(CASE WHEN explicit > 0 THEN explicit END, CASE WHEN known > 0 THEN known END, least(262144, greatest(256, CAST(pow(2, ceil(log2(greatest(1, n // 25)))) AS BIGINT)))) AS nlist FROM a""")
def m08(spark: SparkSession, d: str) -> DataFrame:
    """Buckets for tables of several sizes, some with a number asked for or known from another index."""
    t = Views(spark, d).table("documents")
    n, ids = t.count(), [r.doc_id for r in t.where("doc_id < 60").select("doc_id").collect()]  # 60 ids at most
    rows = [(i, training.resolve_nlist(n * (i + 1), i % 5 if i % 3 == 0 else None, i % 7 if i % 2 == 0 else None)[0]) for i in ids]
    return spark.createDataFrame(rows, "doc_id long, nlist long")


@query("s04_discover_binaries", r"""SELECT DISTINCT path FROM (SELECT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)
WHERE NOT regexp_matches(lower(path), '\.(json|pkl|idb|i64|id0|id1|id2|nam|til|txt|log|c|h|asm)$') AND NOT contains(path, '_srccode/')""")
def s04(spark: SparkSession, d: str) -> DataFrame:
    """Urls' paths stand for files."""
    return tables.discover_binaries(Views(spark, d).table("pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("path")))


@query("s25_f29_classifier", """SELECT a.doc_id AS query_id, b.doc_id + 1 AS func_id, CASE WHEN lower(a.text[1]) = lower(b.text[1]) THEN 1 ELSE 0 END AS label, 6 AS turns,
md5('QUERY:' || chr(10) || a.text || chr(10) || chr(10) || 'CANDIDATE:' || chr(10) || b.text) AS asked FROM documents a JOIN documents b ON b.doc_id + 1 = a.doc_id""")
def s25(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents through a stand-in for a remote classifier: same first character, same host."""
    t = Views(spark, d).table("documents").select("doc_id", "text")
    a = t.select((F.col("doc_id") + 1).alias("func_id"), F.col("text").alias("c_text"))
    pairs = t.select(F.col("doc_id").alias("query_id"), F.col("text").alias("q_text")).join(a, F.col("query_id") == F.col("func_id"))

    def stand_in(q: list[str], c: list[str]) -> list[str]:
        return [f"ANSWER: {'HOST_MATCH' if (x or '')[:1].lower() == (y or '')[:1].lower() else 'NO_MATCH'}" for x, y in zip(q, c, strict=True)]

    shots = (("a", "b", "They differ. ", "NO_MATCH"), ("a", "a", "They agree.", "HOST_MATCH"))
    asked = tables.messages(pairs, "Compare both texts.", shots).select("query_id", F.size("messages").alias("turns"), F.md5(F.element_at("messages", -1)["content"]).alias("asked"))
    answers = tables.classified(pairs.select("query_id", "func_id", "q_text", "c_text"), stand_in)
    return answers.select("query_id", "func_id", parse_label(F.col("answer")).alias("label")).join(asked, "query_id")


@query("f31_f32_encoder", """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents), ok AS (SELECT source FROM t GROUP BY source HAVING bool_and(text <> '' OR doc_id % 50 = 0)),
c AS (SELECT doc_id, list_transform(['e', 't', 'a', 'o', 'i', 'n', 's', 'r'], lambda x: length(text) - length(replace(text, x, ''))) AS v FROM t WHERE source IN (SELECT source FROM ok))
SELECT doc_id AS func_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 6) AS e_share FROM c""")
def f32(spark: SparkSession, d: str) -> DataFrame:
    """Document vectors from a stand-in encoder: letter counts, normalized. A source (as a binary) with an empty text is left out whole; the others are encoded."""
    t = Views(spark, d).table("documents").select(F.col("doc_id").alias("func_id"), F.coalesce("text", F.lit("")).alias("text"), "source")

    def stand_in(texts: list[str]) -> list[list[float]]:
        return [[float(x.count(c)) for c in "etaoinsr"] for x in texts]

    whole = tables.without_gaps(t.withColumn("known", F.col("func_id") % 50 == 0), "source")
    return tables.encoded(whole, stand_in).select("func_id", F.round(F.get(normalized(F.col("emb")), F.lit(0)), 6).alias("e_share"))
