"""Queries of symbols, ground truth, evaluation, pool and sampling, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.vectors import clip01, dot
from ..operators import evaluation as E
from ..operators import pool as P
from ..functions import text as T
from ..operators import retrieval as R
from ..sources import tables
from ..sources.views import TYPES, Views
from .oracle import sql
from .retrieval import _CONST, _EXTRACT, _search, r6, s6, symbols

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = sql(text)
        return f

    return add


_TOKENS = "WITH " + _CONST.removeprefix("WITH ").replace("SELECT DISTINCT func, 'CONST'", "sym AS (SELECT DISTINCT func, 'CONST'", 1) + ")"
_TOKENS = _TOKENS.replace("\nsym AS", ",\nsym AS", 1)
# the number in the first eight hexadecimal digits of a hash
_HASH8 = "list_sum(list_transform(range(1, 9), lambda h: CAST(strpos('0123456789abcdef', md5({k})[h]) - 1 AS BIGINT) * CAST(pow(16, 8 - h) AS BIGINT)))"
_IDF = _TOKENS + ",\nidf AS (SELECT channel, token, count(DISTINCT func) AS df, ln(((SELECT count(*) FROM texts) + 1) / (count(DISTINCT func) + 1)) AS idf FROM sym GROUP BY channel, token)"


@query("a16_token_idf", _IDF + f" SELECT channel, token, df, {s6('idf')} FROM idf")
def a16(spark: SparkSession, d: str) -> DataFrame:
    t = symbols(spark, d)
    n = Views(spark, d).lines().select("func").distinct().count()
    return E.token_idf(t, n).select("channel", "token", "df", *r6("idf"))


# functions of the pool have the symbols of the document with their number, some those of the literal functions as well; every fifth query has none
_ANCHORS = _TOKENS + f""",
strs AS (SELECT DISTINCT func, channel, token FROM ({_EXTRACT}) WHERE channel = 'STRING_LIT'),
all3 AS (SELECT func, channel, token FROM sym UNION SELECT * FROM strs),
owner AS (SELECT func_id, CAST(func_id AS VARCHAR) AS func FROM functions UNION ALL SELECT func_id, 'fix_a' FROM functions WHERE func_id % 4 = 0 UNION ALL SELECT func_id, 'fix_b' FROM functions WHERE func_id % 6 = 1),
pa AS (SELECT DISTINCT func_id, channel, token FROM owner JOIN all3 USING (func)),
qa AS (SELECT DISTINCT query_id, channel, token FROM (SELECT query_id, CAST(gt_func AS VARCHAR) AS func FROM queries UNION ALL SELECT query_id, 'fix_a' FROM queries WHERE query_id % 3 = 0) JOIN all3 USING (func) WHERE query_id % 5 <> 4),
idf AS (SELECT channel, token, ln(((SELECT count(*) FROM functions) + 1) / (count(*) + 1)) AS idf FROM pa GROUP BY channel, token),
pm AS (SELECT func_id, sum(idf) AS mass FROM pa JOIN idf USING (channel, token) GROUP BY func_id), qm AS (SELECT query_id, sum(idf) AS mass FROM qa JOIN idf USING (channel, token) GROUP BY query_id),
ov AS (SELECT b.query_id, b.func_id, sum(idf) AS overlap FROM b JOIN pa USING (func_id) JOIN qa ON qa.query_id = b.query_id AND qa.channel = pa.channel AND qa.token = pa.token JOIN idf ON idf.channel = pa.channel AND idf.token = pa.token GROUP BY b.query_id, b.func_id),
dc AS (SELECT b.*, coalesce(overlap, 0) AS overlap, CASE WHEN overlap > 0 THEN 2 * overlap / (qm.mass + coalesce(pm.mass, 0) + 1e-6) ELSE 0 END AS dice FROM b LEFT JOIN ov USING (query_id, func_id) LEFT JOIN pm USING (func_id) LEFT JOIN qm USING (query_id))"""


def _anchors(spark: SparkSession, d: str, v: Views) -> tuple[DataFrame, DataFrame]:
    """(func_id, channel, token) of the pool and (query_id, channel, token) of the queries: constants, calls and strings."""
    strings = T.block_anchors(T.split_blocks(v.lines())).where("channel = 'STRING_LIT'").select("func", "channel", "token")
    t = symbols(spark, d).unionByName(strings).distinct()
    f, q = v.functions().select("func_id"), v.queries().select("query_id", "gt_func")
    i = F.col("func_id")
    owner = f.select("func_id", F.explode(F.array_compact(F.array(i.cast("string"), F.when(i % 4 == 0, "fix_a"), F.when(i % 6 == 1, "fix_b")))).alias("func"))
    asked = q.where("query_id % 5 <> 4").select("query_id", F.explode(F.array_compact(F.array(F.col("gt_func").cast("string"), F.when(F.col("query_id") % 3 == 0, "fix_a")))).alias("func"))
    return owner.join(t, "func").drop("func").distinct(), asked.join(t, "func").drop("func").distinct()


@query("r03_w07_j07_u02_anchor_rerank", _ANCHORS + f" SELECT query_id, func_id, {s6('overlap', 'dice')}, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.5::DOUBLE * dice, 6) DESC, round(slice_channel, 6) DESC, round(global_sim, 6) DESC, round(slice_score, 6) DESC, binary_name, func_addr) AS rank FROM dc")
def r03(spark: SparkSession, d: str) -> DataFrame:
    """Candidates promoted by shared anchors; queries without any keep their order."""
    s = _search(spark, d)
    pool, asked = _anchors(spark, d, s.v)
    idf = E.token_idf(pool.withColumnRenamed("func_id", "func"), s.v.functions().count()).select("channel", "token", "idf")
    return R.promoted(s.rerank(), pool, asked, idf).select("query_id", "func_id", *r6("overlap", "dice"), F.col("rank").cast("long").alias("rank"))


def _truth(spark: SparkSession, d: str):
    s = _search(spark, d)
    q = s.v.queries()
    keys = E.loose_keys(q, s.v.functions())
    return s, q, keys, E.truth_ranks(s.rerank(), keys, q)


@query("j09_u01_loose_truth", "SELECT query_id, gt_type, func_id FROM gtkeys")
def j09(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    return E.loose_keys(v.queries(), v.functions())


_RECALL = ", ".join(f"round(count(*) FILTER (gt_rank <= {k}) / count(*), 6) AS recall_{k}" for k in E.CUTOFFS)


@query("a18_j10_recall", f"SELECT gt_type, count(*) AS queries, round(count(gt_rank) / count(*), 6) AS gt_recall_rate, {_RECALL} FROM gtrank GROUP BY GROUPING SETS ((), (gt_type))")
def a18(spark: SparkSession, d: str) -> DataFrame:
    r = E.recall(_truth(spark, d)[3])
    return r.select("gt_type", "queries", *r6("gt_recall_rate", *[f"recall_{k}" for k in E.CUTOFFS]))


# the truth is mostly the first candidate: without it, some queries miss
_LATE = "c AS (SELECT query_id, func_id, a_rank - 1 AS rank FROM a WHERE a_rank > 1)"


def _late(s: R.Search) -> DataFrame:
    return s.a().where("a_rank > 1").select("query_id", "func_id", (F.col("a_rank") - 1).alias("rank"))


@query("a19_j11_misses", f"""WITH {_LATE}, t AS (SELECT DISTINCT k.query_id FROM gtkeys k JOIN c USING (query_id, func_id) WHERE rank <= 40),
g AS (SELECT q.query_id, q.gt_type, min(c.rank) AS gt_rank FROM queries q LEFT JOIN gtkeys k ON k.query_id = q.query_id LEFT JOIN c ON c.query_id = k.query_id AND c.func_id = k.func_id AND c.rank <= 40 GROUP BY q.query_id, q.gt_type)
SELECT query_id, gt_type, gt_rank, CASE WHEN query_id IN (SELECT query_id FROM t) THEN 'ranked_out' ELSE 'not_touched' END AS miss_reason FROM g WHERE gt_rank IS NULL OR gt_rank > 1""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    s, q, keys, _ = _truth(spark, d)
    c = _late(s).where("rank <= 40")
    return E.misses(E.truth_ranks(c, keys, q), c, keys, 1).withColumn("gt_rank", F.col("gt_rank").cast("long"))


_A2 = {"all": "0.05::DOUBLE * slice_score + ws * slice_channel + wg * global_sim", "no_base": "ws * slice_channel + wg * global_sim", "no_slice": "0.05::DOUBLE * slice_score + wg * global_sim", "no_global": "0.05::DOUBLE * slice_score + ws * slice_channel", "slice_only": "slice_channel", "global_only": "global_sim"}
_A3 = {"q2f_plus_excess": "q2f + 0.8::DOUBLE * greatest(0, f2q_idf - q2f)", "q2f_only": "q2f", "f2q_only": "f2q", "symmetric_mean": "0.5::DOUBLE * (q2f + f2q)", "max_dir": "greatest(q2f, f2q)"}
_VARIANTS = " UNION ALL ".join([f"SELECT query_id, func_id, binary_name, func_addr, 'a2_{k}' AS variant, {e} AS score FROM w" for k, e in _A2.items()] + [f"SELECT query_id, func_id, binary_name, func_addr, 'a3_{k}', 0.05::DOUBLE * slice_score + ws * ({e}) + wg * global_sim FROM w" for k, e in _A3.items()])


@query("r05_r06_w08_ablation", f"""WITH w AS (SELECT *, 0.85::DOUBLE - 0.55::DOUBLE * alignment AS ws, 0.05::DOUBLE + 0.6::DOUBLE * alignment AS wg FROM b1), v AS ({_VARIANTS}),
r AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(score, 6) DESC, binary_name, func_addr) AS rank FROM v),
g AS (SELECT variant, query_id, min(rank) AS gt_rank FROM r JOIN gtkeys USING (query_id, func_id) GROUP BY ALL)
SELECT variant, count(*) AS found, count(*) FILTER (gt_rank <= 1) AS at_1, count(*) FILTER (gt_rank <= 10) AS at_10, CAST(sum(gt_rank) AS BIGINT) AS rank_sum FROM g GROUP BY variant""")
def r05(spark: SparkSession, d: str) -> DataFrame:
    s, _, keys, _ = _truth(spark, d)
    a, b = F.col("alignment"), F.col("slice_score")
    ws, wg, sc, gl = 0.85 - 0.55 * a, 0.05 + 0.60 * a, F.col("slice_channel"), F.col("global_sim")
    q, f = F.col("q2f"), F.col("f2q")
    scores = {"a2_all": 0.05 * b + ws * sc + wg * gl, "a2_no_base": ws * sc + wg * gl, "a2_no_slice": 0.05 * b + wg * gl, "a2_no_global": 0.05 * b + ws * sc, "a2_slice_only": sc, "a2_global_only": gl}
    units = {"q2f_plus_excess": q + 0.8 * F.greatest(F.lit(0.0), F.col("f2q_idf") - q), "q2f_only": q, "f2q_only": f, "symmetric_mean": 0.5 * (q + f), "max_dir": F.greatest(q, f)}
    scores |= {f"a3_{k}": 0.05 * b + ws * u + wg * gl for k, u in units.items()}
    v = s.rerank().select("query_id", "func_id", "binary_name", "func_addr", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), e.alias("score")) for k, e in scores.items()])).alias("v")).select("*", "v.*")
    w = Window.partitionBy("variant", "query_id").orderBy(F.desc(F.round("score", 6)), "binary_name", "func_addr")
    g = v.withColumn("rank", F.row_number().over(w)).join(keys, ["query_id", "func_id"]).groupBy("variant", "query_id").agg(F.min("rank").alias("gt_rank"))
    return g.groupBy("variant").agg(F.count("*").alias("found"), F.count_if(F.col("gt_rank") <= 1).alias("at_1"), F.count_if(F.col("gt_rank") <= 10).alias("at_10"), F.sum("gt_rank").alias("rank_sum"))


@query("j12_a27_w18_unit_knn", f"""WITH k AS (SELECT q.query_id, q.r, u.func_id, u.vec_id, round(list_dot_product(q.emb, u.emb), 12) AS sim FROM qrows q, units u QUALIFY row_number() OVER (PARTITION BY q.query_id, q.r ORDER BY round(list_dot_product(q.emb, u.emb), 12) DESC, u.vec_id) <= 1000)
SELECT query_id, func_id, count(*) AS hits, round(avg(sim), 6) AS mean_sim FROM k GROUP BY query_id, func_id""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    u = v.units()
    near = R.nearest(v.query_rows().select("query_id", "r", "emb"), ["query_id", "r"], u.select("vec_id", "emb"), "vec_id", 1000, 12)
    return near.join(u.select("vec_id", "func_id"), "vec_id").groupBy("query_id", "func_id").agg(F.count("*").alias("hits"), F.round(F.avg("sim"), 6).alias("mean_sim"))


@query("j13_w19_m0_global_knn", "SELECT q.query_id, g.func_id, round(list_dot_product(q.gq, g.emb), 6) AS sim, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(q.gq, g.emb), 6) DESC, g.func_id) AS rank FROM queries q, globals g QUALIFY rank <= 10")
def j13(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    near = R.nearest(v.queries().select("query_id", F.col("gq").alias("emb")), ["query_id"], v.globals(), "func_id", 10)
    return near.select("query_id", "func_id", "sim", (F.col("rank") + 1).cast("long").alias("rank"))


_AUC = """u AS (SELECT gt_type, score, label FROM s UNION ALL SELECT NULL, score, label FROM s),
r AS (SELECT gt_type, score, label, avg(n) OVER (PARTITION BY gt_type, score) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY gt_type ORDER BY score) AS n FROM u))
SELECT gt_type, CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives, round((sum(rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS auc FROM r GROUP BY gt_type"""


@query("a20_w15_roc_auc", f"""WITH s AS (SELECT q.gt_type, round(score, 6) AS score, CASE WHEN k.func_id IS NOT NULL THEN 1 ELSE 0 END AS label FROM b JOIN queries q USING (query_id) LEFT JOIN gtkeys k ON k.query_id = b.query_id AND k.func_id = b.func_id), {_AUC}""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    """By type, and overall (null)."""
    return E.roc_auc(_scored(spark, d), [[], ["gt_type"]]).select("gt_type", "positives", "negatives", *r6("auc"))


@query("a22_hard_negative_auc", f"""WITH {_LATE}, g AS (SELECT query_id, min(rank) AS gr FROM c JOIN (SELECT DISTINCT query_id, func_id FROM gtkeys) USING (query_id, func_id) GROUP BY query_id HAVING min(rank) > 1),
s AS (SELECT q.gt_type, ((c.func_id * 7 + c.query_id) % 10) / 10 AS score, CASE WHEN rank = gr THEN 1 ELSE 0 END AS label FROM c JOIN g USING (query_id) JOIN queries q USING (query_id) WHERE rank <= gr), {_AUC}""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    """How well a second score (a stand-in for a verifier's) tells truths from what stands above them."""
    s, q, keys, _ = _truth(spark, d)
    h = E.above_truth(_late(s), keys).join(q.select("query_id", "gt_type"), "query_id").withColumn("score", (F.col("func_id") * 7 + F.col("query_id")) % 10 / 10)
    return E.roc_auc(h.select("gt_type", "score", "label"), [[], ["gt_type"]]).select("gt_type", "positives", "negatives", *r6("auc"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s, q, keys, _ = _truth(spark, d)
    k = keys.select("query_id", "func_id").withColumn("label", F.lit(1))
    return s.rerank().join(q.select("query_id", "gt_type"), "query_id").join(k, ["query_id", "func_id"], "left").select("query_id", "gt_type", F.round("score", 6).alias("score"), F.coalesce("label", F.lit(0)).alias("label"))


@query("a21_roc_points", """WITH s AS (SELECT round(score, 6) AS score, CASE WHEN k.func_id IS NOT NULL THEN 1 ELSE 0 END AS label FROM b LEFT JOIN gtkeys k ON k.query_id = b.query_id AND k.func_id = b.func_id),
g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score)
SELECT score, round(sum(n) OVER (ORDER BY score DESC) / greatest(1, sum(n) OVER ()), 6) AS fpr, round(sum(p) OVER (ORDER BY score DESC) / greatest(1, sum(p) OVER ()), 6) AS tpr FROM g""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return E.roc_points(_scored(spark, d)).select("score", *r6("fpr", "tpr"))


@query("a21_roc_grid", """WITH s AS (SELECT round(score, 6) AS score, CASE WHEN k.func_id IS NOT NULL THEN 1 ELSE 0 END AS label FROM b LEFT JOIN gtkeys k ON k.query_id = b.query_id AND k.func_id = b.func_id),
g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score),
pts AS (SELECT sum(n) OVER (ORDER BY score DESC) / greatest(1, sum(n) OVER ()) AS fpr, sum(p) OVER (ORDER BY score DESC) / greatest(1, sum(p) OVER ()) AS tpr FROM g UNION ALL SELECT 0, 0),
grid AS (SELECT i / 100 AS g, i FROM (SELECT unnest(range(101)) AS i)),
lo AS (SELECT g, max(fpr) AS x0 FROM grid, pts WHERE fpr <= g + 1e-11 GROUP BY g), hi AS (SELECT g, min(fpr) AS x1 FROM grid, pts WHERE fpr > g + 1e-11 GROUP BY g),
e AS (SELECT g, x0, x1, (SELECT max(tpr) FROM pts WHERE fpr = x0) AS y0, (SELECT min(tpr) FROM pts WHERE fpr = x1) AS y1 FROM lo LEFT JOIN hi USING (g))
SELECT round(g, 2) AS g, round(y0 + coalesce((y1 - y0) / (x1 - x0), 0) * (g - x0), 6) AS tpr FROM e""")
def a21_grid(spark: SparkSession, d: str) -> DataFrame:
    return E.curve_on_grid(E.roc_points(_scored(spark, d))).select(F.round("g", 2).alias("g"), *r6("tpr"))


_FUSE = """WITH s AS (SELECT b.query_id, b.func_id, b.score, b.rank, CASE WHEN b.func_id % 4 = 0 THEN 1 ELSE 0 END AS label, k.func_id IS NOT NULL AS gt FROM b LEFT JOIN gtkeys k ON k.query_id = b.query_id AND k.func_id = b.func_id WHERE b.rank <= 25),
n AS (SELECT *, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-9 THEN 0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS n01 FROM s WINDOW p AS (PARTITION BY query_id))"""


_FUSED = _FUSE + """, v AS (SELECT lam, n.*, CASE WHEN lam < 0 THEN label + 1e-6 * n01 ELSE n01 + lam * label END AS f FROM n, (SELECT unnest([-1, 0, 0.05, 0.1, 0.2, 0.5, 1, 2]::DOUBLE[]) AS lam)),
r AS (SELECT *, row_number() OVER (PARTITION BY lam, query_id ORDER BY round(f, 9) DESC, rank) AS nr FROM v), g AS (SELECT lam, query_id, min(nr) FILTER (gt) AS gr FROM r GROUP BY lam, query_id)
SELECT lam, count(*) AS queries, count(*) FILTER (gr <= 1) AS at_1, count(*) FILTER (gr <= 10) AS at_10 FROM g GROUP BY lam"""


@query("f26_r07_r08_w09_fusion", _FUSED)
def fusion(spark: SparkSession, d: str) -> DataFrame:
    s, _, keys, _ = _truth(spark, d)
    b = s.rerank().where("rank <= 25").join(keys.select("query_id", "func_id").withColumn("gt", F.lit(True)), ["query_id", "func_id"], "left")
    b = b.select("query_id", "rank", "score", F.coalesce("gt", F.lit(False)).alias("gt"), (F.col("func_id") % 4 == 0).cast("int").alias("label")).withColumn("n01", E.norm01("score", ["query_id"]))
    v = b.withColumn("lam", F.explode(F.array(*map(F.lit, (-1.0, 0.0, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)))))
    v = v.withColumn("f", F.when(F.col("lam") < 0, F.col("label") + 1e-6 * F.col("n01")).otherwise(F.col("n01") + F.col("lam") * F.col("label")))
    r = v.withColumn("nr", F.row_number().over(Window.partitionBy("lam", "query_id").orderBy(F.desc(F.round("f", 9)), "rank")))
    g = r.groupBy("lam", "query_id").agg(F.min(F.when(F.col("gt"), F.col("nr"))).alias("gr"))
    return g.groupBy("lam").agg(F.count("*").alias("queries"), F.count_if(F.col("gr") <= 1).alias("at_1"), F.count_if(F.col("gr") <= 10).alias("at_10"))


@query("a23_best_weight", f"WITH f AS ({_FUSED}) SELECT x.lam, x.at_1 - y.at_1 + x.at_10 - y.at_10 AS gain FROM f x, f y WHERE x.lam > 0 AND y.lam = 0 ORDER BY gain DESC, x.lam LIMIT 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    """The weight of the fusion that gains most over none at ranks 1 and 10, the least of equal ones."""
    f = fusion(spark, d)
    base = f.where("lam = 0").select(F.col("at_1").alias("b1"), F.col("at_10").alias("b10")).first()  # one row
    gain = F.col("at_1") - F.lit(base.b1 if base else 0) + F.col("at_10") - F.lit(base.b10 if base else 0)
    return f.where("lam > 0").select("lam", gain.alias("gain")).orderBy(F.desc("gain"), "lam").limit(1)


@query("f30_cutoffs", "WITH n AS (SELECT count(*) % 997 + 5 AS k FROM documents) SELECT DISTINCT x AS cutoff FROM (SELECT unnest([1, 5, 10, 25, 50, 100, 200, 500, 1000]) AS x UNION ALL SELECT k FROM n), n WHERE x <= k")
def f30(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in E.cutoffs(Views(spark, d).table("documents").count() % 997 + 5)], "cutoff long")


@query("r04_stable_promotion", "SELECT query_id, func_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN func_id % 4 = 0 THEN 1 ELSE 0 END DESC, rank) AS new_rank FROM b WHERE rank <= 25")
def r04(spark: SparkSession, d: str) -> DataFrame:
    b = _search(spark, d).rerank().where("rank <= 25").withColumn("matched", F.col("func_id") % 4 == 0)
    return E.stable_promotion(b).select("query_id", "func_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


@query("a34_a35_j20_s14_pair_scores", f"""WITH drawn AS (SELECT query_id, gt_func, {_HASH8.format(k="query_id || '/' || j")} % (SELECT max(func_id) + 1 FROM functions) AS func_id, j FROM queries, (SELECT unnest(range(16)) AS j)),
neg AS (SELECT x.query_id, x.func_id, 0 AS label FROM (SELECT query_id, gt_func, func_id, min(j) AS j FROM drawn GROUP BY ALL) x JOIN functions g ON g.func_id = x.gt_func JOIN functions f ON f.func_id = x.func_id WHERE f.func_name <> g.func_name
  QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY x.j) <= 5),
pairs AS (SELECT query_id, func_id, 1 AS label FROM gtkeys UNION ALL SELECT * FROM neg),
s AS (SELECT p.query_id, p.func_id, p.label, u.pos, q.r, least(1, greatest(0, list_dot_product(u.emb, q.emb))) AS sim FROM pairs p JOIN units u USING (func_id) JOIN qrows q USING (query_id)),
q AS (SELECT query_id, func_id, label, avg(m) AS q2f FROM (SELECT query_id, func_id, label, r, max(sim) AS m FROM s GROUP BY ALL) GROUP BY ALL), f AS (SELECT query_id, func_id, avg(m) AS f2q FROM (SELECT query_id, func_id, pos, max(sim) AS m FROM s GROUP BY ALL) GROUP BY ALL),
j AS (SELECT q.*, f.f2q, least(1, greatest(0, list_dot_product(g.emb, k.gq))) AS gl, least(q2f, f2q) AS al FROM q JOIN f USING (query_id, func_id) JOIN globals g USING (func_id) JOIN queries k USING (query_id))
SELECT query_id, func_id, label, round((0.85::DOUBLE - 0.55::DOUBLE * al) * (q2f + 0.58::DOUBLE * greatest(0, f2q - q2f)) + (0.05::DOUBLE + 0.6::DOUBLE * al) * gl, 6) AS pair_score, round((q2f + f2q + gl) / 3, 6) AS ensemble_mean, round(greatest(q2f, f2q, gl), 6) AS ensemble_max FROM j""")
def a34(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    q, f = v.queries(), v.functions()
    named = q.join(f.select(F.col("func_id").alias("gt_func"), F.col("func_name").alias("gt_name")), "gt_func").select("query_id", "gt_name")
    # numbers are drawn for each query, those of its own name rejected, the first few that are left taken
    n = f.agg(F.max("func_id") + 1).first()[0] or 1  # one number
    drawn = named.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("func_id", F.conv(F.substring(F.md5(F.concat_ws("/", "query_id", "j")), 1, 8), 16, 10).cast("long") % n)
    drawn = drawn.groupBy("query_id", "gt_name", "func_id").agg(F.min("j").alias("j")).join(f.select("func_id", "func_name"), "func_id").where("func_name <> gt_name")
    neg = P.first_by_priority(drawn, ["query_id"], ["j"], 5).select("query_id", "func_id", F.lit(0).alias("label"))
    pairs = E.loose_keys(q, f).select("query_id", "func_id", F.lit(1).alias("label")).unionByName(neg)
    s = pairs.join(v.units().select("func_id", "pos", "emb"), "func_id").join(v.query_rows().select("query_id", "r", F.col("emb").alias("qe")), "query_id").withColumn("sim", clip01(dot(F.col("emb"), F.col("qe"))))
    key = ["query_id", "func_id"]
    a = s.groupBy(*key, "label", "r").agg(F.max("sim").alias("m")).groupBy(*key, "label").agg(F.avg("m").alias("q2f"))
    b = s.groupBy(*key, "pos").agg(F.max("sim").alias("m")).groupBy(*key).agg(F.avg("m").alias("f2q"))
    j = a.join(b, key).join(v.globals(), "func_id").join(q.select("query_id", "gq"), "query_id").withColumn("gl", clip01(dot(F.col("emb"), F.col("gq")))).withColumn("al", F.least("q2f", "f2q"))
    score = (0.85 - 0.55 * F.col("al")) * (F.col("q2f") + 0.58 * F.greatest(F.lit(0.0), F.col("f2q") - F.col("q2f"))) + (0.05 + 0.60 * F.col("al")) * F.col("gl")
    return j.select(*key, "label", F.round(score, 6).alias("pair_score"), F.round((F.col("q2f") + F.col("f2q") + F.col("gl")) / 3, 6).alias("ensemble_mean"), F.round(F.greatest("q2f", "f2q", "gl"), 6).alias("ensemble_max"))


_HASH = _HASH8 + " % 4"


# a pool of functions from documents: mirrored checkouts and regular builds
_INV = """WITH inv AS (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '-' || substr(md5(CAST(doc_id % 7 AS VARCHAR)), 1, 10) ELSE 'x86-gcc-' || (doc_id % 4) || '-O2-' || source END AS binary_name, '0x' || lower(to_hex(doc_id * 16)) AS func_addr, lang || '_' || (doc_id % 50) AS func_name, len(string_split(text, chr(10))) AS n_lines, CAST(n_chars % 9 AS BIGINT) AS n_units FROM documents),
fam AS (SELECT *, CASE WHEN len(string_split(binary_name, '-')) >= 5 THEN array_to_string(string_split(binary_name, '-')[5:], '-') ELSE binary_name END AS family, CASE WHEN NOT regexp_matches(binary_name, '^[^-]+-[^-]+-[^-]+-[^-]+-.+$') THEN nullif(regexp_extract(binary_name, '^(.+)-[0-9a-fA-F]{10}$', 1), '') END AS case_name FROM inv),
truth AS (SELECT binary_name, func_addr, func_name FROM inv WHERE func_addr IN (SELECT '0x' || lower(to_hex(doc_id * 16)) FROM documents WHERE doc_id % 40 = 3)),
qs AS (SELECT 'q' || (row_number() OVER (ORDER BY func_addr) % 9) AS query_binary, '0x1' AS query_addr, binary_name AS gt_binary, func_addr AS gt_addr, func_name FROM truth),
multi AS (SELECT DISTINCT gt_binary AS binary_name, func_name FROM qs WHERE (query_binary, query_addr) IN (SELECT (query_binary, query_addr) FROM qs GROUP BY query_binary, query_addr HAVING count(DISTINCT (gt_binary, gt_addr)) > 1)),
sib AS (SELECT DISTINCT f.binary_name, f.func_name FROM fam f JOIN fam t ON t.family = f.family AND t.func_name = f.func_name JOIN truth x ON x.binary_name = t.binary_name AND x.func_addr = t.func_addr),
cl0 AS (SELECT DISTINCT case_name, binary_name, func_name FROM fam WHERE case_name IS NOT NULL),
cl1 AS (SELECT *, (binary_name, func_name) IN (SELECT (binary_name, func_name) FROM truth) AS gt FROM cl0),
clone AS (SELECT binary_name, func_name FROM (SELECT *, count(*) OVER p AS n, bool_or(gt) OVER p AS any_gt, min(binary_name) OVER p AS fst FROM cl1 WINDOW p AS (PARTITION BY case_name, func_name)) WHERE n > 1 AND CASE WHEN any_gt THEN NOT gt ELSE binary_name <> fst END)"""


def _inventory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.concat("source", F.lit("-"), F.substring(F.md5((i % 7).cast("string")), 1, 10))).otherwise(F.concat(F.lit("x86-gcc-"), i % 4, F.lit("-O2-"), "source"))
    inv = Views(spark, d).table("documents").select("doc_id", name.alias("binary_name"), F.concat(F.lit("0x"), F.lower(F.hex(i * 16))).alias("func_addr"), F.concat("lang", F.lit("_"), i % 50).alias("func_name"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), (F.col("n_chars") % 9).cast("long").alias("n_units"))
    return inv.drop("doc_id"), inv.where(i % 40 == 3).select("binary_name", "func_addr", "func_name")


def _query_table(truth: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.orderBy("func_addr")) % 9
    return truth.select(F.concat(F.lit("q"), n).alias("query_binary"), F.lit("0x1").alias("query_addr"), F.col("binary_name").alias("gt_binary"), F.col("func_addr").alias("gt_addr"), "func_name")


@query("a28_multi_target", _INV + " SELECT * FROM multi")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return P.multi_target(_query_table(_inventory(spark, d)[1]))


@query("j16_siblings", _INV + " SELECT * FROM sib")
def j16(spark: SparkSession, d: str) -> DataFrame:
    inv, truth = _inventory(spark, d)
    return P.siblings(truth, inv)


@query("a29_clones", _INV + " SELECT * FROM clone")
def a29(spark: SparkSession, d: str) -> DataFrame:
    inv, truth = _inventory(spark, d)
    return P.clones(truth, inv)


_POOL = _INV + """, ex AS (SELECT * FROM multi UNION SELECT * FROM sib UNION SELECT * FROM clone),
gt AS (SELECT * FROM inv WHERE (binary_name, func_addr) IN (SELECT (binary_name, func_addr) FROM truth)),
fill AS (SELECT i.*, row_number() OVER (PARTITION BY i.binary_name ORDER BY CAST(i.func_addr AS BIGINT)) AS k, coalesce(c.c0, 0) AS c0 FROM (SELECT inv.* FROM inv ANTI JOIN truth USING (binary_name, func_addr)) i ANTI JOIN ex USING (binary_name, func_name) LEFT JOIN (SELECT binary_name, count(*) AS c0 FROM gt GROUP BY binary_name) c USING (binary_name) WHERE i.n_lines > 8),
turns AS (SELECT *, CASE WHEN c0 = 0 THEN k - 1 ELSE k END AS turn, CASE WHEN c0 = 0 THEN 1 ELSE c0 END AS c1 FROM fill),
pool AS (SELECT binary_name, func_addr, func_name, n_lines, n_units, true AS is_gt FROM gt UNION ALL (SELECT binary_name, func_addr, func_name, n_lines, n_units, false FROM turns ORDER BY turn, CASE WHEN turn = 0 THEN 0 ELSE c1 END, binary_name LIMIT (SELECT greatest(0, 150 - count(*)) FROM gt)))"""
_POOL = _POOL.replace("CAST(i.func_addr AS BIGINT)", "list_sum(list_transform(range(3, length(i.func_addr) + 1), lambda j: (strpos('0123456789abcdef', i.func_addr[j]) - 1) * pow(16, length(i.func_addr) - j)))")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    inv, truth = _inventory(spark, d)
    ex = P.multi_target(_query_table(truth)).unionByName(P.siblings(truth, inv)).unionByName(P.clones(truth, inv)).distinct()
    return P.select_pool(inv, truth, ex, 150)


@query("j14_short_truths", _INV + " SELECT qs.* FROM qs LEFT JOIN inv ON inv.binary_name = gt_binary AND inv.func_addr = gt_addr WHERE n_lines IS NULL OR n_lines > 8")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose truth is too short to be found go."""
    inv, truth = _inventory(spark, d)
    return P.long_enough(_query_table(truth), inv)


@query("u03_exclusion_counts", _POOL + """ SELECT (SELECT count(*) FROM multi) AS multi, (SELECT count(*) FROM sib) AS siblings, (SELECT count(*) FROM clone) AS clones, (SELECT count(*) FROM ex) AS either,
(SELECT count(*) FROM (SELECT * FROM sib EXCEPT SELECT * FROM multi)) AS siblings_alone, (SELECT count(*) FROM (SELECT * FROM clone EXCEPT (SELECT * FROM multi UNION SELECT * FROM sib))) AS clones_alone""")
def u03(spark: SparkSession, d: str) -> DataFrame:
    """What each rule excludes, and what it adds to the rules before it."""
    inv, truth = _inventory(spark, d)
    parts = {"multi": P.multi_target(_query_table(truth)), "siblings": P.siblings(truth, inv), "clones": P.clones(truth, inv)}
    return P.exclusion_counts(parts)


@query("w12_j15_pool_selection", _POOL + " SELECT * FROM pool")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


@query("w13_w14_a33_dense_ids", _POOL + """ SELECT binary_name, func_addr, func_name, row_number() OVER (ORDER BY binary_name, func_addr, func_name) - 1 AS func_id,
CAST(coalesce(sum(n_units) OVER (ORDER BY binary_name, func_addr, func_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_unit FROM pool""")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return P.dense_ids(_pool(spark, d)).select("binary_name", "func_addr", "func_name", F.col("func_id").cast("long").alias("func_id"), F.col("first_unit").cast("long").alias("first_unit"))


@query("s06_first_root_wins", r"""WITH f AS (SELECT doc_id % 3 AS root, '/r' || (doc_id % 3) || '/' || coalesce(lang, 'x') || '/' || source || '-' || (doc_id % 40) AS base, doc_id % 7 <> 0 AS there FROM documents),
n AS (SELECT DISTINCT root, base, regexp_extract(base, '([^/]*)$', 1) AS binary_name FROM f WHERE base IN (SELECT base FROM f WHERE there))
SELECT binary_name, base || '_bb_slice_feature.json' AS feature_path, base || '_embeddings.pkl' AS embedding_path FROM n QUALIFY row_number() OVER (PARTITION BY binary_name ORDER BY root, base) = 1""")
def s06(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    f = Views(spark, d).table("documents").select((i % 3).alias("root"), F.concat(F.lit("/r"), i % 3, F.lit("/"), F.coalesce("lang", F.lit("x")), F.lit("/"), "source", F.lit("-"), i % 40).alias("base"), (i % 7 != 0).alias("there"))
    files = f.select("root", F.concat("base", F.lit(tables.FEATURES)).alias("path")).unionByName(f.where("there").select("root", F.col("base").alias("path")))
    return tables.pool_binaries(files)


@query("s05_s08_j08_source_priority", """WITH f AS (SELECT source, lang, doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS priority FROM documents)
SELECT source, lang, doc_id, priority FROM f QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY priority, doc_id) = 1""")
def s05(spark: SparkSession, d: str) -> DataFrame:
    f = Views(spark, d).table("documents").select("source", "lang", "doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("priority"))
    return P.first_by_priority(f, ["source", "lang"], ["priority", "doc_id"])


@query("s07_j01_s11_features_join", "SELECT f.func_id, count(u.pos) AS usable, bool_and(len(u.emb) = 64) AS complete FROM functions f LEFT JOIN units u ON u.func_id = f.func_id AND u.generic_penalty < 0.7 GROUP BY f.func_id")
def s07(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    u = v.units().where("generic_penalty < 0.7").select("func_id", "pos", "emb")
    return v.functions().select("func_id").join(u, "func_id", "left").groupBy("func_id").agg(F.count("pos").alias("usable"), F.bool_and(F.size("emb") == 64).alias("complete"))


@query("s19_j19_u04_needed_texts", """SELECT d.doc_id, coalesce(c.text, d.text) IS NOT NULL AS has_text, md5(coalesce(c.text, d.text)) AS text_md5 FROM documents d LEFT JOIN (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) c ON c.conv_id = d.doc_id WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def s19(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    last = P.first_by_priority(v.table("conversations"), ["conv_id"], [F.desc("turn")]).select(F.col("conv_id").alias("doc_id"), F.col("text").alias("own"))
    need = v.table("labels").where("quality = 1").select("doc_id")
    t = v.table("documents").select("doc_id", "text").join(need, "doc_id", "left_semi").join(last, "doc_id", "left").withColumn("t", F.coalesce("own", "text"))
    return t.select("doc_id", F.col("t").isNotNull().alias("has_text"), F.md5("t").alias("text_md5"))


@query("j17_patch", "SELECT o_orderkey, coalesce(CASE WHEN l.n > 4 THEN l.q END, o_totalprice) AS o_totalprice, coalesce(l.n > 4, false) AS patched FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def j17(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    cache = v.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("o_totalprice")).where("n > 4")
    return P.patched(v.table("orders").select("o_orderkey", "o_totalprice"), cache, ["o_orderkey"], "o_totalprice")




@query("j18_substitute", f"""WITH f AS (SELECT CAST(func_id AS VARCHAR) AS key, func_name, func_id % 6 = 0 AS broken FROM functions), dn AS (SELECT key AS donor, func_name FROM f WHERE NOT broken),
nm AS (SELECT f.key, dn.donor FROM f JOIN dn USING (func_name) WHERE f.broken AND f.func_name IN (SELECT func_name FROM functions WHERE func_id % 4 = 0) QUALIFY row_number() OVER (PARTITION BY f.key ORDER BY md5(f.key || '/' || dn.donor), dn.donor) = 1),
bk AS (SELECT {_HASH.format(k='donor')} AS h, min(donor) AS any_donor FROM dn GROUP BY h)
SELECT f.key, f.func_name, coalesce(nm.donor, bk.any_donor, (SELECT min(donor) FROM dn)) AS donor FROM f LEFT JOIN nm USING (key) LEFT JOIN bk ON bk.h = {_HASH.format(k='f.key')} WHERE f.broken""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    f = Views(spark, d).functions().select(F.col("func_id").cast("string").alias("key"), "func_name", "func_id")
    wanted = f.where("func_id % 4 = 0").select("func_name").distinct()
    return P.substituted(f.where("func_id % 6 = 0").select("key", "func_name"), f.where("func_id % 6 <> 0").select("key", "func_name"), wanted)


@query("m01_m02_w11_balanced_sample", """WITH c AS (SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 60),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 9) SELECT * FROM s ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def m01(spark: SparkSession, d: str) -> DataFrame:
    t = Views(spark, d).table("documents").select("doc_id", "source", "lang")
    return P.sampled(P.capped(P.capped(t, "lang", 60, "doc_id"), "source", 9, "doc_id"), 100, "doc_id")


@query("m03_frequency_balanced", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 20 AS first FROM documents)
SELECT doc_id, lang FROM r ORDER BY first DESC, md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 120""")
def m03(spark: SparkSession, d: str) -> DataFrame:
    t = Views(spark, d).table("documents").select("doc_id", "lang")
    first = P.capped(t, "lang", 20, "doc_id").withColumn("tier", F.lit(0))
    rest = t.join(first.select("doc_id"), "doc_id", "left_anti").withColumn("tier", F.lit(1))
    return first.unionByName(rest).orderBy("tier", P.pick_order("doc_id"), "doc_id").limit(120).select("doc_id", "lang")


@query("m04_w17_uniform_stride", "WITH s AS (SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 90) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM s) WHERE n % 3 = 0")
def m04(spark: SparkSession, d: str) -> DataFrame:
    s = P.sampled(Views(spark, d).table("documents").select("doc_id"), 90, "doc_id")
    return s.withColumn("n", F.row_number().over(Window.orderBy("doc_id")) - 1).where("n % 3 = 0").select("doc_id")


@query("f22_f23_sizes", """WITH n AS (SELECT count(*) * p AS n FROM documents, (SELECT unnest([1, 10, 100, 1000, 100000]) AS p) GROUP BY p),
l AS (SELECT n, least(262144, greatest(256, CAST(pow(2, ceil(log2(greatest(1, n // 25)))) AS BIGINT))) AS nlist FROM n)
SELECT n, greatest(500, CAST(ceil(6 * sqrt(n)) AS BIGINT)) AS cap, nlist, least(n, greatest(16 * nlist, 30000)) AS train_size FROM l""")
def f22(spark: SparkSession, d: str) -> DataFrame:
    n = Views(spark, d).table("documents").agg(F.count("*").alias("c")).select(F.explode(F.array(*[F.col("c") * k for k in (1, 10, 100, 1000, 100000)])).alias("n"))
    least = F.greatest(F.lit(1), F.floor(F.col("n") / 25))
    n = n.withColumn("nlist", F.least(F.lit(262144), F.greatest(F.lit(256), F.pow(2.0, F.ceil(F.log2(least))).cast("long"))))
    return n.select("n", S.candidate_cap(F.col("n")).alias("cap"), "nlist", F.least("n", F.greatest(16 * F.col("nlist"), F.lit(30000))).alias("train_size"))


_SIGNS = 24


@query("f24_sign_signatures", f"WITH p AS (SELECT bucket_id AS bit, emb FROM centroids WHERE bucket_id < {_SIGNS}) SELECT u.func_id, u.pos, CAST(sum(CASE WHEN list_dot_product(u.emb, p.emb) > 0 THEN pow(2, bit) ELSE 0 END) AS BIGINT) AS signature FROM units u, p GROUP BY u.func_id, u.pos")
def f24(spark: SparkSession, d: str) -> DataFrame:
    v = Views(spark, d)
    near = R.nearest(v.units().select("func_id", "pos", "emb"), ["func_id", "pos"], v.centroids().where(f"bucket_id < {_SIGNS}"), "bucket_id", _SIGNS, 12)
    return near.groupBy("func_id", "pos").agg(F.sum(F.when(F.col("sim") > 0, F.expr("shiftleft(1L, bucket_id)")).otherwise(0)).alias("signature"))


@query("f27_a18_type_counts", "SELECT CASE gt_type WHEN 0 THEN 'root' WHEN 1 THEN 'internal' ELSE 'leaf' END AS type_name, count(*) AS queries FROM queries GROUP BY gt_type")
def f27(spark: SparkSession, d: str) -> DataFrame:
    return Views(spark, d).queries().select(F.get(F.array(*map(F.lit, TYPES)), F.col("gt_type")).alias("type_name")).groupBy("type_name").agg(F.count("*").alias("queries"))


@query("a32_latency_summary", f"WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type) SELECT event_type, n, {s6('mean', 'p50', 'p95', digits=4)} FROM s")
def a32(spark: SparkSession, d: str) -> DataFrame:
    """Mean and percentiles of a table of timings; event values stand for them."""
    s = Views(spark, d).table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95"))
    return s.select("event_type", "n", *r6("mean", "p50", "p95", digits=4))


@query("s09_s10_query_limits", """WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 4 END AS t FROM documents WHERE n_chars > 0)
SELECT doc_id, source, coalesce(t, 2) AS gt_type FROM n WHERE n <= 7 ORDER BY source, doc_id LIMIT 100""")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """So many queries a file and in all, files by name; a missing type is 2."""
    t = Views(spark, d).table("documents").where("n_chars > 0")
    n = t.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 7").orderBy("source", "doc_id").limit(100)
    return n.select("doc_id", "source", F.coalesce(F.when(F.col("doc_id") % 4 != 3, F.col("doc_id") % 4), F.lit(2)).cast("long").alias("gt_type"))


@query("s12_s13_usable_vectors", "SELECT label, count(*) AS rows, count(*) FILTER (len(embedding) = 64 AND vec_id % 11 <> 0) AS usable, count(*) FILTER (NOT (len(embedding) = 64 AND vec_id % 11 <> 0)) AS dropped FROM embeddings GROUP BY label")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the expected size by group, with what is dropped; every eleventh counts as missing."""
    v = Views(spark, d).table("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 11 != 0, F.col("embedding")))
    ok = F.coalesce(F.size("embedding") == 64, F.lit(False))
    return v.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(ok).alias("usable"), F.count_if(~ok).alias("dropped"))


@query("s22_a33_manifest", _POOL + " SELECT binary_name, count(*) AS selected, count(*) FILTER (is_gt) AS gt, (SELECT count(*) FROM pool) AS pool_size, (SELECT count(*) FROM ex) AS excluded FROM pool GROUP BY binary_name")
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the selected pool by binary, with the totals a manifest states."""
    inv, truth = _inventory(spark, d)
    ex = P.multi_target(_query_table(truth)).unionByName(P.siblings(truth, inv)).unionByName(P.clones(truth, inv)).distinct()
    pool = P.select_pool(inv, truth, ex, 150)
    n, excluded = pool.count(), ex.count()
    return pool.groupBy("binary_name").agg(F.count("*").alias("selected"), F.count_if("is_gt").alias("gt")).withColumn("pool_size", F.lit(n)).withColumn("excluded", F.lit(excluded))


@query("s26_names", r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) || '_bb_slice_feature.json', '_feature\.json$', '_embeddings') AS embedding_name FROM pages")
def s26(spark: SparkSession, d: str) -> DataFrame:
    """Names of derived files from those of feature files."""
    base = F.concat(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), F.lit("_bb_slice_feature.json"))
    return Views(spark, d).table("pages").select("page_id", F.regexp_replace(base, r"_feature\.json$", "_embeddings").alias("embedding_name"))
