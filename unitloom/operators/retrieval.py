"""Coarse index, candidate generation and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import posting_order, posting_signal, query_weight, rank_affinity, unit_prior
from ..functions.vectors import clip01, dot
from ..sources.views import bounded

#: Bytes of a side's vectors that go out as one matrix at most.
MATRIX_BYTES = 64 << 20
# fixed values: fusion weights
EXCESS, BASE, GLOBAL_LOW, GLOBAL_HIGH, UNIT_LOW, UNIT_HIGH = 0.80, 0.05, 0.05, 0.65, 0.30, 0.85
HUGE_BASE, HUGE_UNIT, HUGE_GLOBAL, HUGE_PENALTY = 0.05, 0.70, 0.05, 0.30


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, ties by id."""
    return np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(left: DataFrame, keys: list[str], right: DataFrame, right_key: str, k: int, digits: int = 6, limit: int = MATRIX_BYTES) -> DataFrame:
    """keys, rank (from 0), right_key, sim: the k right vectors with the largest inner products, rounded; ties by right_key.

    If the right side's vectors fit in limit bytes, they go out as one matrix, and each Arrow batch of left vectors is one product.
    Else the left side goes out in blocks of so many bytes; each task over the right side keeps its own k best for each
    left vector, and one window merges those.
    """
    kinds = dict(left.dtypes) | dict(right.dtypes)
    spark = left.sparkSession
    left = left.select(*keys, F.col("emb").cast("array<double>").alias("emb"))
    right = right.select(right_key, F.col("emb").cast("array<double>").alias("emb"))
    dims = right.select(F.size("emb").alias("n")).first()
    rows = max(1, limit // (8 * max(1, dims.n if dims else 1)))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), f"rank int, {right_key} {kinds[right_key]}, sim double"])
    arrow = pa.int32() if kinds[right_key] == "int" else pa.int64() if kinds[right_key] == "bigint" else pa.string()
    if bounded(right, rows):
        t = right.toArrow()
        held = spark.sparkContext.broadcast((t.column(right_key).to_numpy(), _matrix(t.column("emb").combine_chunks()) if t.num_rows else None))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
                if not len(ids):
                    continue
                sims = np.round(_matrix(b.column(len(keys))) @ matrix.T, digits) + 0.0
                top = _best(sims, ids, k)
                n = top.shape[1]
                cols = [c.take(pa.array(np.repeat(np.arange(b.num_rows), n))) for c in b.columns[: len(keys)]]
                cols += [pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), pa.array(ids[top].ravel()).cast(arrow), pa.array(np.take_along_axis(sims, top, 1).ravel())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "rank", right_key, "sim"])

        return left.mapInArrow(work, schema)
    blocks = -(-left.count() // rows)
    found = None
    for i in range(max(1, blocks)):
        part = _nearest_block(left.where(F.pmod(F.xxhash64(*keys), F.lit(max(1, blocks))) == i), keys, right, right_key, k, digits, schema, arrow)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy(*keys).orderBy(F.desc("sim"), right_key)
    return found.drop("rank").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select(*keys, (F.col("n") - 1).alias("rank"), right_key, "sim")


def _nearest_block(left: DataFrame, keys: list[str], right: DataFrame, right_key: str, k: int, digits: int, schema: str, arrow: pa.DataType) -> DataFrame:
    """Each task's k best right vectors for each vector of a block of left ones."""
    t = left.toArrow().combine_chunks()
    held = left.sparkSession.sparkContext.broadcast((t.select(keys), _matrix(t.column("emb").combine_chunks()) if t.num_rows else None))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        if matrix is None:
            return
        sims, ids = np.zeros((len(matrix), 0)), np.zeros((len(matrix), 0), object)
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            mine = b.column(0).to_numpy(zero_copy_only=False)
            sims = np.concatenate([sims, np.round(matrix @ _matrix(b.column(1)).T, digits) + 0.0], axis=1)
            ids = np.concatenate([ids, np.broadcast_to(mine, (len(matrix), len(mine)))], axis=1)
            o = np.stack([np.lexsort((i, -s)) for i, s in zip(ids, sims, strict=True)])[:, :k]
            sims, ids = np.take_along_axis(sims, o, 1), np.take_along_axis(ids, o, 1)
        n = sims.shape[1]
        if n:
            cols = [c.combine_chunks().take(pa.array(np.repeat(np.arange(len(matrix)), n))) for c in names.columns]
            cols += [pa.array(np.zeros(n * len(matrix), np.int32)), pa.array(ids.ravel().tolist(), arrow), pa.array(sims.ravel())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names.column_names, "rank", right_key, "sim"])

    return right.mapInArrow(work, schema)


def bucket_hits(units: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """func_id, pos, rank, bucket_id, contribution (prior x rank affinity, as one division, so that it is rounded once), prior: every unit in its k nearest buckets."""
    d = units.withColumn("prior", unit_prior(F.col("slice_kind"), F.col("slice_quality"), F.col("semantic_role"), F.col("generic_penalty")))
    near = nearest(units.select("func_id", "pos", "emb"), ["func_id", "pos"], centroids, "bucket_id", k)
    return near.join(d.select("func_id", "pos", "prior", "slice_kind"), ["func_id", "pos"]).withColumn("c", F.col("prior") / F.sqrt(F.col("rank") + 1))


def ordered_sum(c: Column) -> Column:
    """The sum of a group's values, added in ascending order, so that it has the same bits with any partitioning. Null if there is none. A group's values are held as one list."""
    return F.aggregate(F.sort_array(F.collect_list(c)), F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, x))


def postings(hits: DataFrame) -> DataFrame:
    """bucket_id, func_id, best, support, signal, pos: the inverted index with each list's order (from 1)."""
    buckets = hits.groupBy("func_id").agg(F.count_distinct("bucket_id").alias("buckets"))
    p = hits.where("prior > 0").groupBy("bucket_id", "func_id").agg(F.max("c").alias("best"), ordered_sum(F.col("c")).alias("support"))
    p = p.join(buckets, "func_id").withColumn("signal", posting_signal(F.col("best"), F.col("support"), F.col("buckets")))
    order = [F.desc(F.round(posting_order(F.col("best"), F.col("support")), 9)), F.desc(F.round("best", 9)), F.desc(F.round("support", 9)), "func_id"]
    return p.withColumn("pos", F.row_number().over(Window.partitionBy("bucket_id").orderBy(*order))).drop("buckets")


def kind_postings(hits: DataFrame) -> DataFrame:
    """Per (bucket, function): best and support over all units, and over two kinds alone."""
    def only(kind: str):
        return F.when(F.col("slice_kind") == kind, F.col("c"))

    return hits.where("prior > 0").groupBy("bucket_id", "func_id").agg(
        F.max("c").alias("best"), ordered_sum(F.col("c")).alias("support"), *[f(only(k)).alias(f"{n}_{s}") for k, n in (("var_chain", "var"), ("coverage_chain", "cov")) for f, s in ((F.max, "best"), (ordered_sum, "support"))]
    )


def bucket_stats(post: DataFrame, functions: DataFrame) -> DataFrame:
    """posting_len, df_ratio, idf, hot_weight, query_weight of all buckets up to the highest used; empty ones count."""
    spark = post.sparkSession
    n = functions.count()
    top = post.agg(F.max("bucket_id")).first()[0]
    lens = post.groupBy("bucket_id").agg(F.count("*").alias("len"))
    d = spark.range(0, (top if top is not None else -1) + 1).select(F.col("id").cast("int").alias("bucket_id")).join(lens, "bucket_id", "left").select("bucket_id", F.coalesce("len", F.lit(0)).alias("posting_len"))
    limit = d.where("posting_len > 0").agg(F.greatest(F.lit(1.0), F.ceil(F.percentile("posting_len", F.lit(0.99)))).alias("t")).first().t or 1.0
    d = d.withColumn("df_ratio", F.col("posting_len") / max(1, n)).withColumn("idf", F.log((F.lit(n) + 1) / (F.col("posting_len") + 1)) + 1)
    ratio = F.col("posting_len") / limit
    d = d.withColumn("hot_weight", F.when(ratio <= 1, 1.0).otherwise(F.greatest(F.lit(0.35), 1 / F.sqrt(ratio))))
    return d.withColumn("query_weight", query_weight(F.col("idf"), F.col("df_ratio"), F.col("posting_len"), F.col("hot_weight")))


def function_stats(units: DataFrame, hits: DataFrame, post: DataFrame) -> DataFrame:
    a = units.groupBy("func_id").agg(F.count("*").alias("unit_count"))
    b = hits.groupBy("func_id").agg(F.count_distinct("bucket_id").alias("bucket_count"))
    c = post.groupBy("func_id").agg(F.sum("support").alias("total_support"))
    return a.join(b, "func_id", "left").join(c, "func_id", "left").select("func_id", "unit_count", F.coalesce("bucket_count", F.lit(0)).alias("bucket_count"), F.coalesce("total_support", F.lit(0.0)).alias("total_support"))


def unit_idf(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """func_id, pos, unit_idf: idf of the unit's nearest bucket over the mean of all units; the mean where that bucket is not known."""
    d = hits.where("rank = 0").join(stats.select("bucket_id", "idf"), "bucket_id", "left")
    mean = d.agg(F.avg("idf")).first()[0] or 1.0
    d = d.withColumn("i", F.coalesce("idf", F.lit(mean)))
    return d.select("func_id", "pos", (F.col("i") / mean).alias("unit_idf"))


def query_profile(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, r, emb, gq, w: row weights, prior times alignment with the global vector over its mean."""
    d = rows.withColumn("prior", unit_prior(F.col("slice_kind"), F.col("slice_quality"), F.col("semantic_role"), F.col("generic_penalty"))).join(queries.select("query_id", "gq"), "query_id")
    w = Window.partitionBy("query_id")
    d = d.withColumn("w0", F.when(F.sum("prior").over(w) <= 0, 1.0).otherwise(F.col("prior"))).withColumn("a", F.greatest(F.lit(0.0), dot(F.col("emb"), F.col("gq"))))
    mean = F.avg("a").over(w)
    return d.withColumn("w", F.when(mean > 1e-6, F.col("w0") * F.col("a") / mean).otherwise(F.col("w0"))).select("query_id", "r", "emb", "gq", "w")


def stage_a(profile: DataFrame, centroids: DataFrame, post: DataFrame, stats: DataFrame, fstats: DataFrame, functions: DataFrame, buckets: int = 16, cap: int | None = None) -> DataFrame:
    """Candidates by bucket evidence: query_id, func_id, hit_count, support_mass ... slice_score, a_rank."""
    pivot = stats.agg(F.median("idf")).first()[0] or 0.0
    hits = nearest(profile.select("query_id", "r", "emb"), ["query_id", "r"], centroids, "bucket_id", buckets).join(stats.select("bucket_id", "idf", "query_weight"), "bucket_id")
    top = F.max("idf").over(Window.partitionBy("query_id", "r"))
    mult = F.when((F.lit(pivot) > 0) & (top > 0), F.least(F.lit(1.4), F.greatest(F.lit(0.6), top / max(pivot, 1e-6)))).otherwise(1.0)
    e = hits.withColumn("mult", mult).withColumn("aff", rank_affinity(F.col("rank"))).join(post.select("bucket_id", "func_id", "signal"), "bucket_id")
    e = e.withColumn("s", F.col("aff") * F.col("query_weight") * F.col("signal")).withColumn("ev", F.col("s") * F.greatest(F.lit(0.0), F.col("idf") / max(pivot, 1e-6)))
    rf = e.groupBy("query_id", "r", "func_id").agg(F.sum("s").alias("s"), F.max("ev").alias("ev"), F.first("mult").alias("mult"))
    rf = rf.join(profile.select("query_id", "r", "w"), ["query_id", "r"]).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "r"))).withColumn("rw", F.col("w") * F.col("mult"))
    f = rf.groupBy("query_id", "func_id").agg(F.count("*").alias("hit_count"), F.sum("rw").alias("hit_weight"), F.sum(F.col("rw") * F.col("s")).alias("support_mass"), F.sum(F.col("rw") / F.sqrt("n")).alias("selectivity_mass"), F.max("ev").alias("maxb"))
    q = profile.groupBy("query_id").agg(F.greatest(F.lit(1e-6), F.sum("w")).alias("tqw"), F.count("*").alias("rows"))
    f = f.join(q, "query_id").join(fstats, "func_id")
    fsc, one = F.greatest(F.lit(1), F.col("unit_count")), F.lit(1.0)
    sym = F.greatest(F.lit(1), F.least("rows", fsc))
    f = f.withColumn("qwr", F.least(one, F.col("hit_weight") / F.greatest(F.lit(1e-6), F.col("tqw") * sym / F.greatest(F.lit(1), F.col("rows"))))).withColumn("phr", F.least(one, F.col("hit_count") / fsc))
    f = f.withColumn("sup", 1 - F.exp(-F.col("support_mass") / F.col("tqw"))).withColumn("sel", F.col("selectivity_mass") / F.col("tqw")).withColumn("spec", F.least(one, F.col("support_mass") / F.greatest(F.lit(1e-6), F.col("total_support"))))
    score = 0.10 * F.col("qwr") + 0.28 * F.col("phr") + 0.20 * F.col("sup") + 0.18 * F.col("spec") + 0.14 * F.least("qwr", "phr") + 0.10 * F.col("sel") + 0.8 * F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.col("maxb")))
    f = f.withColumn("slice_score", score).join(functions.select("func_id", "binary_name", "func_addr"), "func_id")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("slice_score", 6)), F.desc(F.round("sup", 6)), F.desc("hit_count"), "binary_name", "func_addr")
    limit = cap if cap is not None else max(500, int(np.ceil(6 * np.sqrt(functions.count()))))
    return f.withColumn("a_rank", F.row_number().over(w)).where(F.col("a_rank") <= limit)


#: A row counts as highly similar from here; a row or unit takes part in a match from this share of the best and above this floor.
HIGH, SHARE, FLOOR = 0.5, 0.5, 0.2
_EVIDENCE = ("q2f", "q2f_idf", "f2q", "f2q_idf", "conn")


def matched(cand: DataFrame, profile: DataFrame, units: DataFrame, idf: DataFrame) -> DataFrame:
    """query_id, func_id, evidence of both directions, and how many rows and units take part: one small product for each candidate, in Arrow batches."""
    u = units.select("func_id", "pos", "emb").join(idf, ["func_id", "pos"]).groupBy("func_id").agg(F.sort_array(F.collect_list(F.struct("pos", "emb", F.col("unit_idf").alias("i")))).alias("u"))
    u = u.select("func_id", F.flatten("u.emb").alias("ue"), F.col("u.i").alias("ui"))
    q = profile.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "emb", "w"))).alias("q"))
    q = q.select("query_id", F.flatten("q.emb").alias("qe"), F.col("q.w").alias("qw"), F.col("q.r").cast("array<double>").alias("qr"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for ue, ui, qe, qw, qr in zip(*((x.values.to_numpy(zero_copy_only=False) for x in c) for c in b.columns[2:]), strict=True):
                sim = np.clip(qe.reshape(len(qw), -1) @ ue.reshape(len(ui), -1).T, 0.0, 1.0)
                row, unit = sim.max(1), sim.max(0)
                high = qr[row >= HIGH]
                out.append((
                    (qw * row).sum() / max(1e-6, qw.sum()), (qw * (sim * ui).max(1)).sum() / max(1e-6, qw.sum()), unit.mean(), (ui * unit).sum() / max(1e-6, ui.sum()),
                    1.0 if len(high) <= 1 else len(high) / (high.max() - high.min() + 1), *(int(((m >= SHARE * m.max()) & (m > FLOOR)).sum()) for m in (row, unit)),
                ))
            cols = [pa.array(c, pa.float64() if i < len(_EVIDENCE) else pa.int64()) for i, c in enumerate(zip(*out, strict=True))] if out else []
            if cols:
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], names=["query_id", "func_id", *_EVIDENCE, "matched_rows", "matched_units"])

    kinds = dict(cand.dtypes)
    schema = f"query_id {kinds['query_id']}, func_id {kinds['func_id']}, " + ", ".join(f"{c} double" for c in _EVIDENCE) + ", matched_rows long, matched_units long"
    return cand.select("query_id", "func_id").join(u, "func_id").join(q, "query_id").select("query_id", "func_id", "ue", "ui", "qe", "qw", "qr").mapInArrow(work, schema)


def stage_b(cand: DataFrame, profile: DataFrame, units: DataFrame, idf: DataFrame, globals_: DataFrame, huge: bool = False) -> DataFrame:
    """Reranked candidates: q2f, f2q, q2f_idf, f2q_idf, global_sim, alignment, slice_channel, score, rank, conn, matched_rows, matched_units."""
    g = cand.join(globals_.withColumnRenamed("emb", "ge"), "func_id").join(profile.groupBy("query_id").agg(F.first("gq").alias("gq")), "query_id")
    g = g.select("query_id", "func_id", "slice_score", "hit_count", "binary_name", "func_addr", clip01(dot(F.col("ge"), F.col("gq"))).alias("global_sim"))
    d = g.join(matched(cand, profile, units, idf), ["query_id", "func_id"]).withColumn("alignment", F.least("q2f", "f2q"))
    return ranked(d.withColumn("slice_channel", channel(huge)).withColumn("score", fused(huge)))


def channel(huge: bool = False):
    more, less = F.greatest(F.lit(0.0), F.col("f2q_idf") - F.col("q2f")), F.greatest(F.lit(0.0), F.col("q2f") - F.col("f2q_idf"))
    return F.col("q2f") + EXCESS * more - (HUGE_PENALTY * less if huge else F.lit(0.0))


def fused(huge: bool = False):
    if huge:
        return HUGE_BASE * F.col("slice_score") + HUGE_UNIT * F.col("slice_channel") + HUGE_GLOBAL * F.col("global_sim")
    a = F.col("alignment")
    return BASE * F.col("slice_score") + (UNIT_HIGH - (UNIT_HIGH - UNIT_LOW) * a) * F.col("slice_channel") + (GLOBAL_LOW + (GLOBAL_HIGH - GLOBAL_LOW) * a) * F.col("global_sim")


def ranked(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*[F.desc(F.round(c, 6)) for c in ("score", "slice_channel", "global_sim", "slice_score")], "binary_name", "func_addr")
    return d.withColumn("rank", F.row_number().over(w))


def promoted(d: DataFrame, anchors: DataFrame, query_anchors: DataFrame, idf: DataFrame, weight: float = 0.5) -> DataFrame:
    """Reranked candidates once more by shared anchors: overlap, dice, and score + weight x dice, ranked anew.

    anchors: func_id, channel, token of the pool; query_anchors: query_id, channel, token; idf: channel, token, idf over the pool. Queries
    without anchors keep their scores and order. Only a query's own candidates are looked at.
    """
    of = lambda t, key: t.join(idf, ["channel", "token"]).groupBy(key).agg(F.sum("idf").alias("mass"))
    shared = d.select("query_id", "func_id").join(anchors, "func_id").join(query_anchors, ["query_id", "channel", "token"]).join(idf, ["channel", "token"])
    shared = shared.groupBy("query_id", "func_id").agg(F.sum("idf").alias("overlap"))
    j = d.join(shared, ["query_id", "func_id"], "left").join(of(anchors, "func_id").withColumnRenamed("mass", "pool_mass"), "func_id", "left").join(of(query_anchors, "query_id").withColumnRenamed("mass", "query_mass"), "query_id", "left")
    overlap = F.coalesce("overlap", F.lit(0.0))
    dice = F.when(overlap > 0, 2 * overlap / (F.col("query_mass") + F.coalesce("pool_mass", F.lit(0.0)) + 1e-6)).otherwise(0.0)
    return ranked(j.withColumn("overlap", overlap).withColumn("dice", dice).withColumn("score", F.col("score") + weight * F.col("dice")).drop("pool_mass", "query_mass"))


def demoted(d: DataFrame) -> DataFrame:
    """The connectivity verifier: score x (1 - .4 (1 - conn)), ranked anew."""
    return ranked(d.withColumn("score", F.col("score") * (1 - 0.4 * (1 - F.col("conn")))))


class Search:
    """All stages over one set of views, each built when first asked for.

    Stages that several later ones read are kept in memory or on disk of the executors, and made anew where one is lost;
    close() lets them go.
    """

    KEPT = ("hits", "post", "stats", "fstats", "idf", "profile", "a")

    def __init__(self, views, pool_buckets: int = 24, query_buckets: int = 16, cap: int | None = None):
        self.v, self.k, self.b, self.cap = views, pool_buckets, query_buckets, cap
        self._made: dict = {}

    def _once(self, name: str, make):
        if name not in self._made:
            df = make()
            self._made[name] = df.persist() if name in self.KEPT else df
        return self._made[name]

    def close(self) -> None:
        for name in self.KEPT:
            if name in self._made:
                self._made.pop(name).unpersist()

    def hits(self):
        return self._once("hits", lambda: bucket_hits(self.v.units(), self.v.centroids(), self.k))

    def post(self):
        return self._once("post", lambda: postings(self.hits()))

    def stats(self):
        return self._once("stats", lambda: bucket_stats(self.post(), self.v.functions()))

    def fstats(self):
        return self._once("fstats", lambda: function_stats(self.v.units(), self.hits(), self.post()))

    def idf(self):
        return self._once("idf", lambda: unit_idf(self.hits(), self.stats()))

    def profile(self):
        return self._once("profile", lambda: query_profile(self.v.query_rows(), self.v.queries()))

    def a(self):
        return self._once("a", lambda: stage_a(self.profile(), self.v.centroids(), self.post(), self.stats(), self.fstats(), self.v.functions(), self.b, self.cap))

    def rerank(self, huge: bool = False):
        return self._once(f"b{huge}", lambda: stage_b(self.a(), self.profile(), self.v.units(), self.idf(), self.v.globals(), huge))
