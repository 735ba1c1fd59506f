"""Queries of text, index, search and reranking, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import retrieval as R
from ..sources.views import ADDRESSES, ANSWERS, NAMES, Views
from .oracle import ADDRESSES_SQL, ANSWERS_SQL, NAMES_SQL, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = sql(text)
        return f

    return add


def r6(*names: str, digits: int = 6) -> list:
    return [(F.round(n, digits) + 0.0).alias(n) for n in names]


def s6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


@query("f01_f02_w01_split_blocks", "SELECT func, line_index, bb_id FROM blocks")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return T.split_blocks(Views(spark, d).lines()).select("func", "line_index", F.col("bb_id").cast("long").alias("bb_id"))


_EXTRACT = r"""WITH found AS (
  SELECT func, bb_id, 'CONTROL_KEYWORDS' AS channel, unnest(regexp_extract_all(al, '\b(if|for|while|switch|goto|return|break|continue)\b', 1)) AS token FROM blocks
  UNION ALL SELECT func, bb_id, 'CONST_HEX', CASE WHEN ltrim(lower(x), '0') = '' THEN '0x0' ELSE '0x' || ltrim(lower(x), '0') END FROM (SELECT func, bb_id, unnest(regexp_extract_all(al, '\b0[xX]([0-9a-fA-F]+)(?:[uULl]+)?\b', 1)) AS x FROM blocks)
  UNION ALL SELECT func, bb_id, 'DEREF_PATTERN', unnest(regexp_extract_all(al, '\*\s*\(\s*(_?(?:BYTE|WORD|DWORD|QWORD|OWORD|TBYTE))\s*\*?\s*\*?\s*\)', 1)) FROM blocks
  UNION ALL SELECT func, bb_id, 'STRING_LIT', unnest(regexp_extract_all(al, '"([^"\\]*(?:\\.[^"\\]*)*)"', 1)) FROM blocks)
SELECT DISTINCT func, bb_id, channel, token FROM found
WHERE (channel <> 'STRING_LIT' OR length(token) >= 4) AND (channel <> 'CONST_HEX' OR token NOT IN ('0x0', '0x1', '0x2', '0x3', '0x4', '0x5', '0x6', '0x7', '0x8', '0xf', '0xff', '0xfff', '0xffff'))"""


@query("f03_block_anchors", _EXTRACT)
def f03(spark: SparkSession, d: str) -> DataFrame:
    return T.block_anchors(T.split_blocks(Views(spark, d).lines())).withColumn("bb_id", F.col("bb_id").cast("long"))


def _label(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN '0' WHEN {n} = 1 THEN '1' WHEN {n} <= 3 THEN '2-3' WHEN {n} <= 7 THEN '4-7' WHEN {n} <= 15 THEN '8-15' WHEN {n} <= 31 THEN '16-31' WHEN {n} <= 63 THEN '32-63' ELSE '64+' END"


_COUNT = r"CAST(sum(len(regexp_extract_all(regexp_replace(coalesce(line, ''), '[^\x00-\x7F]', '_', 'g'), '\b({})\b'))) AS BIGINT)"


@query("f04_f05_fingerprints", f"""WITH c AS (SELECT func, {_COUNT.format('if|switch')} AS n_branches, {_COUNT.format('for|while')} AS n_loops, {_COUNT.format('return')} AS n_returns FROM lines GROUP BY func)
SELECT *, {_label('n_branches')} AS branches, {_label('n_loops')} AS loops, {_label('n_returns')} AS returns FROM c""")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return T.fingerprints(Views(spark, d).lines())


@query("f06_block_records", "SELECT func, bb_id, n_lines, md5(pseudo) AS pseudo_md5 FROM records")
def f06(spark: SparkSession, d: str) -> DataFrame:
    r = T.block_records(T.split_blocks(Views(spark, d).lines()))
    return r.select("func", F.col("bb_id").cast("long").alias("bb_id"), "n_lines", F.md5("pseudo").alias("pseudo_md5"))


@query("f11_s18_function_texts", "SELECT func, length(text) AS n_chars, md5(text) AS text_md5 FROM texts")
def f11(spark: SparkSession, d: str) -> DataFrame:
    t = T.function_texts(T.block_records(T.split_blocks(Views(spark, d).lines())))
    return t.select("func", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


_CONST = r"""WITH tok AS (SELECT DISTINCT func, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b(0[xX][0-9a-fA-F]+|\d+)\b', 1)) AS t FROM texts),
d AS (SELECT func, lower(t) AS t, ltrim(substr(lower(t), 3), '0') AS h FROM tok),
n AS (SELECT func, t, CASE WHEN t LIKE '0x%' THEN CASE WHEN length(h) <= 16 THEN coalesce(list_sum(list_transform(range(1, length(h) + 1), lambda i: CAST(strpos('0123456789abcdef', h[i]) - 1 AS HUGEINT) * CAST(pow(16, length(h) - i) AS HUGEINT))), 0) END ELSE CASE WHEN length(t) <= 38 THEN TRY_CAST(t AS HUGEINT) END END AS v FROM d),
c AS (SELECT func, t, CASE WHEN v >= 18446744073709547520 AND v < 18446744073709551616 THEN v - 18446744073709551616 WHEN v >= 4294963200 AND v < 4294967296 THEN v - 4294967296 ELSE v END AS v FROM n)
SELECT DISTINCT func, 'CONST' AS channel, coalesce(CAST(v AS VARCHAR), t) AS token FROM c WHERE v IS NULL OR abs(v) NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 20, 24, 31, 32, 48, 63, 64, 96, 100, 127, 128, 200, 255, 256, 512, 1000, 1024, 2048, 4096, 8192, 16384, 32768, 65535, 65536)
UNION ALL SELECT DISTINCT func, 'CALL', n FROM (SELECT func, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Za-z_]\w{2,})\s*\(', 1)) AS n FROM texts)
WHERE n <> func AND NOT regexp_matches(n, '^(sub_|loc_|nullsub|j_)') AND n NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'else', 'do', 'goto', '__fastcall', '__cdecl', '__int64', 'unsigned', 'int', 'char', 'void')"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    t = T.function_texts(T.block_records(T.split_blocks(Views(spark, d).lines())))
    c = t.select("func", F.lit("CONST").alias("channel"), F.explode(T.constants(F.col("text"))).alias("token"))
    return c.unionByName(t.select("func", F.lit("CALL").alias("channel"), F.explode(T.calls(F.col("text"), F.col("func"))).alias("token")))


@query("f12_f13_s21_constants_calls", _CONST)
def f12(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d)


_ADDR = rf"""WITH adr AS (SELECT col0 AS addr FROM (VALUES {ADDRESSES_SQL}) t(col0) UNION ALL SELECT unnest(['0x' || lower(to_hex(doc_id * 37)), CAST(doc_id AS VARCHAR), 'q' || doc_id]) FROM documents),
s AS (SELECT addr, lower(trim(addr)) AS s FROM adr),
h AS (SELECT addr, s, CASE WHEN regexp_full_match(s, '0x[0-9a-f]{{1,15}}') THEN substr(s, 3) WHEN regexp_full_match(s, '[0-9]{{1,18}}') THEN NULL WHEN regexp_full_match(s, '[0-9a-f]{{1,15}}') THEN s END AS h FROM s),
n AS (SELECT addr, CASE WHEN h IS NOT NULL THEN CAST(list_sum(list_transform(range(1, length(h) + 1), lambda i: CAST(strpos('0123456789abcdef', h[i]) - 1 AS BIGINT) * CAST(pow(16, length(h) - i) AS BIGINT))) AS BIGINT) WHEN regexp_full_match(s, '[0-9]{{1,18}}') THEN CAST(s AS BIGINT) END AS n FROM h)
SELECT addr, coalesce(CAST(n AS VARCHAR), trim(addr)) AS addr_key, coalesce('0x' || lower(to_hex(n)), trim(addr)) AS addr_hex, row_number() OVER (ORDER BY n IS NULL, n, addr) AS sort_rank FROM n"""


@query("f08_f09_f10_addresses", _ADDR)
def f08(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    i = F.col("doc_id")
    more = v.table("documents").select(F.explode(F.array(F.concat(F.lit("0x"), F.lower(F.hex(i * 37))), i.cast("string"), F.concat(F.lit("q"), i.cast("string")))).alias("addr"))
    a = v.texts(ADDRESSES, "addr").unionByName(more).withColumn("n", T.address_number(F.col("addr")))
    w = Window.orderBy(F.col("n").isNull(), "n", "addr")
    return a.select("addr", T.address_key(F.col("addr")).alias("addr_key"), T.address_hex(F.col("addr")).alias("addr_hex"), F.row_number().over(w).cast("long").alias("sort_rank"))


@query("f14_f15_identity", rf"""WITH n AS (SELECT col0 AS name FROM (VALUES {NAMES_SQL}) t(col0) UNION ALL SELECT unnest([source || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 10), 'x86-gcc-9-O2-' || source]) FROM documents),
base AS (SELECT name, regexp_extract(name, '([^/]*)$', 1) AS b FROM n),
m AS (SELECT *, b <> '' AND NOT regexp_matches(b, '^[^-]+-[^-]+-[^-]+-[^-]+-.+$') AS is_mirrored, string_split(b, '-') AS p FROM base)
SELECT name, CASE WHEN len(p) >= 5 THEN array_to_string(p[5:], '-') ELSE b END AS family, is_mirrored, CASE WHEN is_mirrored THEN nullif(regexp_extract(b, '^(.+)-[0-9a-fA-F]{{10}}$', 1), '') END AS case_name FROM m""")
def f14(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    names = v.table("documents").select(F.explode(F.array(F.concat("source", F.lit("-"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 10)), F.concat(F.lit("x86-gcc-9-O2-"), "source"))).alias("name"))
    n = v.texts(NAMES, "name").unionByName(names)
    return n.select("name", T.family(F.col("name")).alias("family"), T.is_mirrored(F.col("name")).alias("is_mirrored"), T.case_name(F.col("name")).alias("case_name"))


@query("f27_f28_labels", rf"""WITH ans AS (SELECT col0 AS answer FROM (VALUES {ANSWERS_SQL}) t(col0) UNION ALL SELECT 'x ANSWER: ' || ['NO_MATCH', 'HOST_MATCH', 'INLINE_MATCH'][doc_id % 3 + 1] || CAST(doc_id AS VARCHAR) FROM documents),
u AS (SELECT answer, upper(answer) AS u, length(answer) - strpos(reverse(upper(answer)), ':REWSNA') - 6 AS p FROM ans),
t AS (SELECT *, CASE WHEN contains(u, 'ANSWER:') THEN substr(u, p + 8, 40) END AS t, list_transform(['NO_MATCH', 'HOST_MATCH', 'INLINE_MATCH'], lambda x: CASE WHEN contains(u, x) THEN length(u) - strpos(reverse(u), reverse(x)) - length(x) + 2 ELSE 0 END) AS l FROM u)
SELECT answer, CAST(coalesce(CASE WHEN contains(t, 'NO_MATCH') THEN 0 WHEN contains(t, 'HOST_MATCH') THEN 1 WHEN contains(t, 'INLINE_MATCH') THEN 2 END, CASE regexp_extract(t, '^\s*(\S)', 1) WHEN 'N' THEN 0 WHEN 'H' THEN 1 WHEN 'I' THEN 2 END,
  CASE WHEN list_max(l) = 0 THEN NULL WHEN l[1] >= l[2] AND l[1] >= l[3] THEN 0 WHEN l[2] >= l[3] THEN 1 ELSE 2 END) AS BIGINT) AS label FROM t""")
def f28(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    i = F.col("doc_id")
    more = v.table("documents").select(F.concat(F.lit("x ANSWER: "), F.get(F.array(*map(F.lit, T.LABELS)), (i % 3).cast("int")), i.cast("string")).alias("answer"))
    return v.texts(ANSWERS, "answer").unionByName(more).select("answer", T.parse_label(F.col("answer")).cast("long").alias("label"))


@query("f17_f18_s12_function_globals", f"SELECT func_id, i - 1 AS dim, {s6('x')} FROM (SELECT func_id, unnest(range(1, len(emb) + 1)) AS i, unnest(emb) AS x FROM globals)")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return Views(spark, d).globals().select("func_id", F.posexplode("emb").alias("dim", "x")).select("func_id", F.col("dim").cast("long").alias("dim"), *r6("x"))


def _search(spark: SparkSession, d: str) -> R.Search:
    return R.Search(Views(spark, d))


@query("j02_f21_w02_bucket_hits", f"SELECT func_id, pos, CAST(rank AS BIGINT) AS rank, bucket_id, {s6('sim', 'prior', 'c')} FROM hits")
def j02(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).hits().select("func_id", "pos", F.col("rank").cast("long").alias("rank"), "bucket_id", *r6("sim", "prior", "c"))


@query("f21_l2_affinity", """WITH k AS (SELECT u.func_id, u.pos, c.bucket_id, round(2 - 2 * round(list_dot_product(u.emb, c.emb), 9), 6) AS dist FROM units u, centroids c),
r AS (SELECT *, row_number() OVER (PARTITION BY func_id, pos ORDER BY dist, bucket_id) - 1 AS rank, min(dist) OVER (PARTITION BY func_id, pos) AS best FROM k QUALIFY rank < 4)
SELECT func_id, pos, rank, bucket_id, dist, round(exp(-greatest(0, dist - best) / greatest(best * 2.5::DOUBLE, 1e-4)) / sqrt(rank + 1), 6) AS affinity FROM r""")
def f21(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    near = R.nearest(v.units().select("func_id", "pos", "emb"), ["func_id", "pos"], v.centroids(), "bucket_id", 8, 9)
    near = near.withColumn("dist", F.round(2 - 2 * F.col("sim"), 6))
    w = Window.partitionBy("func_id", "pos")
    near = near.withColumn("rank", (F.row_number().over(w.orderBy("dist", "bucket_id")) - 1).cast("long")).withColumn("best", F.min("dist").over(w)).where("rank < 4")
    return near.select("func_id", "pos", "rank", "bucket_id", "dist", F.round(S.l2_affinity(F.col("rank"), F.col("dist"), F.col("best")), 6).alias("affinity"))


@query("a01_a03_f19_w03_postings", f"SELECT bucket_id, func_id, {s6('best', 'support', 'signal')}, pos FROM post")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).post().select("bucket_id", "func_id", *r6("best", "support", "signal"), F.col("pos").cast("long").alias("pos"))


@query("a02_kind_postings", f"""WITH p AS (SELECT bucket_id, func_id, max(c) AS best, sum(c) AS support, max(c) FILTER (slice_kind = 'var_chain') AS var_best, sum(c) FILTER (slice_kind = 'var_chain') AS var_support,
  max(c) FILTER (slice_kind = 'coverage_chain') AS cov_best, sum(c) FILTER (slice_kind = 'coverage_chain') AS cov_support FROM hits WHERE prior > 0 GROUP BY bucket_id, func_id)
SELECT bucket_id, func_id, {s6('best', 'support', 'var_best', 'var_support', 'cov_best', 'cov_support')} FROM p""")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return R.kind_postings(_search(spark, d).hits()).select("bucket_id", "func_id", *r6("best", "support", "var_best", "var_support", "cov_best", "cov_support"))


@query("a04_a06_a15_f20_bucket_stats", f"SELECT bucket_id, posting_len, {s6('df_ratio', 'idf', 'hot_weight', 'query_weight')} FROM stats")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).stats().select("bucket_id", "posting_len", *r6("df_ratio", "idf", "hot_weight", "query_weight"))


@query("a05_function_stats", f"SELECT func_id, unit_count, bucket_count, {s6('total_support')} FROM fstats")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).fstats().select("func_id", "unit_count", "bucket_count", *r6("total_support"))


@query("a14_unit_idf", f"SELECT func_id, pos, {s6('unit_idf')} FROM uidf")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).idf().select("func_id", "pos", *r6("unit_idf"))


@query("a24_hotspots", f"""WITH s AS (SELECT count(*) AS buckets, count(*) FILTER (posting_len > 0) AS nonempty, avg(posting_len) AS mean_all, avg(posting_len) FILTER (posting_len > 0) AS mean_nonempty,
  quantile_cont(posting_len, 0.5) FILTER (posting_len > 0) AS p50, quantile_cont(posting_len, 0.9) FILTER (posting_len > 0) AS p90, quantile_cont(posting_len, 0.95) FILTER (posting_len > 0) AS p95, quantile_cont(posting_len, 0.99) FILTER (posting_len > 0) AS p99,
  max(posting_len) AS longest, count(*) FILTER (posting_len >= 5) AS ge_5, count(*) FILTER (posting_len >= 10) AS ge_10, count(*) FILTER (posting_len >= 50) AS ge_50, count(*) FILTER (posting_len >= 100) AS ge_100, count(*) FILTER (posting_len >= 500) AS ge_500 FROM lens)
SELECT buckets, nonempty, {s6('mean_all', 'mean_nonempty', 'p50', 'p90', 'p95', 'p99')}, longest, ge_5, ge_10, ge_50, ge_100, ge_500 FROM s""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("posting_len")
    full = F.when(n > 0, n)
    s = _search(spark, d).stats().agg(F.count("*").alias("buckets"), F.count(full).alias("nonempty"), F.avg(n).alias("mean_all"), F.avg(full).alias("mean_nonempty"), *[F.percentile(full, F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max(n).alias("longest"), *[F.count_if(n >= k).alias(f"ge_{k}") for k in (5, 10, 50, 100, 500)])
    return s.select("buckets", "nonempty", *r6("mean_all", "mean_nonempty", "p50", "p90", "p95", "p99"), "longest", *[f"ge_{k}" for k in (5, 10, 50, 100, 500)])


@query("w16_top_buckets", f"SELECT bucket_id, posting_len, {s6('df_ratio')} FROM lens WHERE posting_len > 0 ORDER BY posting_len DESC, bucket_id LIMIT 20")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).stats().where("posting_len > 0").orderBy(F.desc("posting_len"), "bucket_id").limit(20).select("bucket_id", "posting_len", *r6("df_ratio"))


@query("a25_a26_diagnostics", f"""WITH n AS (SELECT func_id, sqrt(list_dot_product(emb, emb)) AS l FROM units), s AS (SELECT func_id, avg(l) AS mean_norm, min(l) AS min_norm, max(l) AS max_norm FROM n GROUP BY func_id)
SELECT func_id, bucket_count, {s6('mean_norm', 'min_norm', 'max_norm')} FROM s JOIN fstats USING (func_id)""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    n = s.v.units().select("func_id", F.sqrt(R.dot(F.col("emb"), F.col("emb"))).alias("l")).groupBy("func_id").agg(F.avg("l").alias("mean_norm"), F.min("l").alias("min_norm"), F.max("l").alias("max_norm"))
    return n.join(s.fstats().select("func_id", "bucket_count"), "func_id").select("func_id", "bucket_count", *r6("mean_norm", "min_norm", "max_norm"))


@query("r09_f16_query_profile", f"SELECT query_id, CAST(r AS BIGINT) AS r, {s6('w')} FROM prof")
def r09(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).profile().select("query_id", F.col("r").cast("long").alias("r"), *r6("w"))


_A = ("hit_weight", "support_mass", "selectivity_mass", "maxb", "slice_score")


@query("a07_a10_r10_w05_stage_a", f"SELECT query_id, func_id, hit_count, {s6(*_A)}, a_rank FROM a")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).a().select("query_id", "func_id", "hit_count", *r6(*_A), F.col("a_rank").cast("long").alias("a_rank"))


_B = ("q2f", "f2q", "q2f_idf", "f2q_idf", "global_sim", "slice_channel", "score")


@query("a11_a13_r01_w06_stage_b", f"SELECT query_id, func_id, {s6(*_B)}, rank FROM b")
def stage_b(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).rerank().select("query_id", "func_id", *r6(*_B), F.col("rank").cast("long").alias("rank"))


@query("r01_huge_pool", f"""WITH h AS (SELECT * REPLACE (q2f + 0.8::DOUBLE * greatest(0, f2q_idf - q2f) - 0.3::DOUBLE * greatest(0, q2f - f2q_idf) AS slice_channel) FROM b1),
s AS (SELECT *, 0.05::DOUBLE * slice_score + 0.7::DOUBLE * slice_channel + 0.05::DOUBLE * global_sim AS score FROM h)
SELECT query_id, func_id, {s6('slice_channel', 'score')}, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, round(slice_channel, 6) DESC, round(global_sim, 6) DESC, round(slice_score, 6) DESC, binary_name, func_addr) AS rank FROM s""")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).rerank(huge=True).select("query_id", "func_id", *r6("slice_channel", "score"), F.col("rank").cast("long").alias("rank"))


@query("r02_a30_connectivity", f"""WITH s AS (SELECT * REPLACE (score * (1 - 0.4::DOUBLE * (1 - conn)) AS score) FROM b2)
SELECT query_id, func_id, {s6('conn', 'score')}, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, round(slice_channel, 6) DESC, round(global_sim, 6) DESC, round(slice_score, 6) DESC, binary_name, func_addr) AS rank FROM s""")
def r02(spark: SparkSession, d: str) -> DataFrame:
    return R.demoted(_search(spark, d).rerank()).select("query_id", "func_id", *r6("conn", "score"), F.col("rank").cast("long").alias("rank"))


@query("w10_top_results", f"SELECT query_id, rank, func_id, b.binary_name, b.func_addr, b.func_name, {s6('score')} FROM b WHERE rank <= 10")
def top_results(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    b = s.rerank().where("rank <= 10").join(s.v.functions().select("func_id", "func_name"), "func_id")
    return b.select("query_id", F.col("rank").cast("long").alias("rank"), "func_id", "binary_name", "func_addr", "func_name", *r6("score"))


@query("a31_matched_units", """WITH m AS (SELECT query_id, func_id, m, max(m) OVER (PARTITION BY query_id, func_id) AS top FROM brow), p AS (SELECT query_id, func_id, pos, max(sim) AS m FROM sims GROUP BY ALL),
pm AS (SELECT query_id, func_id, m, max(m) OVER (PARTITION BY query_id, func_id) AS top FROM p)
SELECT query_id, func_id, matched_rows, matched_units FROM (SELECT query_id, func_id, count(*) FILTER (m >= 0.5 * top AND m > 0.2) AS matched_rows FROM m GROUP BY ALL)
JOIN (SELECT query_id, func_id, count(*) FILTER (m >= 0.5 * top AND m > 0.2) AS matched_units FROM pm GROUP BY ALL) USING (query_id, func_id)""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    """How many rows and units of both sides take part in the match."""
    return _search(spark, d).rerank().select("query_id", "func_id", "matched_rows", "matched_units")


@query("w05_capped_candidates", "SELECT query_id, func_id, a_rank FROM a WHERE a_rank <= 7")
def w05(spark: SparkSession, d: str) -> DataFrame:
    """Stage A with a cap that bites."""
    return R.Search(Views(spark, d), cap=7).a().select("query_id", "func_id", F.col("a_rank").cast("long").alias("a_rank"))
