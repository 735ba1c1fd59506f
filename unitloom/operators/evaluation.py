"""Ground truth, recall, ROC and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 25, 50, 100, 200, 500, 1000)


def loose_keys(queries: DataFrame, functions: DataFrame) -> DataFrame:
    """query_id, gt_type, func_id: the ground truth itself and all functions of its name."""
    f = functions.select("func_id", "func_name")
    named = queries.join(f.withColumnRenamed("func_id", "gt_func"), "gt_func", "left")
    same = named.where("func_name <> ''").join(f, "func_name").select("query_id", "gt_type", "func_id")
    return same.unionByName(queries.select("query_id", "gt_type", F.col("gt_func").alias("func_id"))).distinct()


def truth_ranks(ranked: DataFrame, keys: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, gt_type, gt_rank: the best rank of any key, null if none is ranked."""
    best = ranked.select("query_id", "func_id", "rank").join(keys, ["query_id", "func_id"]).groupBy("query_id").agg(F.min("rank").alias("gt_rank"))
    return queries.select("query_id", "gt_type").join(best, "query_id", "left")


def recall(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """gt_type (null: all), queries, gt_recall_rate and recall at each cutoff, overall and by type in one pass."""
    share = [(F.count_if(F.col("gt_rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in cutoffs]
    sets = ranks.groupingSets([[], [F.col("gt_type")]], F.col("gt_type"))
    return sets.agg(F.count("*").alias("queries"), (F.count("gt_rank") / F.count("*")).alias("gt_recall_rate"), *share)


def misses(ranks: DataFrame, touched: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """Queries whose truth is not within k: not_touched if no key was a candidate, else ranked_out."""
    seen = keys.join(touched.select("query_id", "func_id"), ["query_id", "func_id"], "left_semi").select("query_id").distinct().withColumn("seen", F.lit(True))
    m = ranks.where(F.col("gt_rank").isNull() | (F.col("gt_rank") > k)).join(seen, "query_id", "left")
    return m.select("query_id", "gt_type", "gt_rank", F.when(F.col("seen"), "ranked_out").otherwise("not_touched").alias("miss_reason"))


def roc_auc(scores: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Area under the curve of (score, label) for each grouping set: a pair counts 1 if the positive is higher, half if both tie; null without both classes.

    Rows are counted by score first, so that only distinct scores are put in order.
    """
    by = sorted({c for x in sets for c in x})
    d = scores.groupingSets([[*map(F.col, x), F.col("score")] for x in sets], *by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    return d.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), (F.sum("won") / F.nullif((F.sum("p") * F.sum("n")).cast("double"), F.lit(0.0))).alias("auc"))


def roc_points(scores: DataFrame) -> DataFrame:
    """Curve points at tie borders: threshold, fpr, tpr; counted per score first, then summed along scores."""
    d = scores.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    w, all_ = Window.orderBy(F.desc("score")), Window.partitionBy()
    return d.select("score", (F.sum("n").over(w) / F.greatest(F.lit(1), F.sum("n").over(all_))).alias("fpr"), (F.sum("p").over(w) / F.greatest(F.lit(1), F.sum("p").over(all_))).alias("tpr"))


def curve_on_grid(points: DataFrame, steps: int = 100) -> DataFrame:
    """g, tpr: the curve from (0, 0) at steps + 1 evenly spaced false positive rates, straight between points; of points with one rate the last holds."""
    spark = points.sparkSession
    p = points.select("fpr", "tpr").unionByName(spark.createDataFrame([(0.0, 0.0)], "fpr double, tpr double")).groupBy("fpr").agg(F.min("tpr").alias("low"), F.max("tpr").alias("tpr"))
    w = Window.orderBy("fpr")
    p = p.withColumn("next", F.lead("fpr").over(w)).withColumn("next_low", F.lead("low").over(w))
    # each stretch between points brings its own grid places
    first, last = F.ceil(F.col("fpr") * steps - 1e-9), F.when(F.col("next").isNull(), F.lit(steps)).otherwise(F.ceil(F.col("next") * steps - 1e-9) - 1)
    p = p.where(last >= first).withColumn("i", F.explode(F.sequence(first, last))).withColumn("g", F.col("i") / steps)
    slope = F.coalesce((F.col("next_low") - F.col("tpr")) / (F.col("next") - F.col("fpr")), F.lit(0.0))
    return p.select("g", (F.col("tpr") + slope * (F.col("g") - F.col("fpr"))).alias("tpr"))


def above_truth(ranked: DataFrame, keys: DataFrame) -> DataFrame:
    """ranked rows of queries whose best key is ranked, but not first: that key (label 1) and all that stand above it (label 0)."""
    best = ranked.join(keys.select("query_id", "func_id").distinct(), ["query_id", "func_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("gt_rank")).where("gt_rank > 1")
    return ranked.join(best, "query_id").where(F.col("rank") <= F.col("gt_rank")).withColumn("label", (F.col("rank") == F.col("gt_rank")).cast("int")).drop("gt_rank")


def cutoffs(top_k: int) -> list[int]:
    """The cutoffs up to top_k, and top_k itself."""
    return sorted({k for k in CUTOFFS if k <= top_k} | {top_k})


def norm01(c: str, by: list[str]) -> Column:
    """Scaled to [0, 1] within groups; 0 where the range is below 1e-9."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi - lo < 1e-9, 0.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))


def stable_promotion(window: DataFrame) -> DataFrame:
    """New ranks: matched rows first, each part in its old order."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("matched").cast("int")), "rank")
    return window.withColumn("new_rank", F.row_number().over(w))


def overlap_mass(left: DataFrame, right: DataFrame, idf: DataFrame) -> DataFrame:
    """(left key, right key, overlap): summed idf of shared tokens by channel, for pairs that share any."""
    j = left.join(right, ["channel", "token"]).join(idf, ["channel", "token"])
    return j.groupBy("lkey", "rkey").agg(F.sum("idf").alias("overlap"))


def token_idf(tokens: DataFrame, total: int) -> DataFrame:
    """channel, token, df, idf = ln((N + 1) / (df + 1))."""
    return tokens.groupBy("channel", "token").agg(F.count_distinct("func").alias("df")).withColumn("idf", F.log(F.lit(total + 1) / (F.col("df") + 1)))
