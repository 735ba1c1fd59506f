"""Hand-checked numbers and properties."""

import itertools
import math

import pytest

from pyspark.sql import functions as F

from unitloom.functions import scoring as S
from unitloom.functions import text as T
from unitloom.operators import evaluation as E
from unitloom.operators import pool as P
from unitloom.operators import retrieval as R
from unitloom.sources.views import mean_vectors


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_inner_product_affinity_is_rank_decay_alone(spark):
    assert value(spark, S.rank_affinity(F.lit(3))) == 0.5


def test_posting_signal(spark):
    got = value(spark, S.posting_signal(F.lit(1.0), F.lit(2.0), F.lit(4)))
    assert math.isclose(got, 0.58 * (1 - math.exp(-1.6)) + 0.30 * (1 - math.exp(-1.7)) + 0.06)
    assert value(spark, S.posting_signal(F.lit(0.0), F.lit(0.0), F.lit(4))) == 0.0


def test_stop_bucket_weight(spark):
    df, length, idf = 0.18, 1800, 1.5
    dt, pt = 1 - 2.5 * df, 1 / math.sqrt(length / 32)
    want = min(0.55, idf * max(0.18, dt * pt) * max(0.18, math.sqrt(dt * pt)))
    assert math.isclose(value(spark, S.query_weight(F.lit(idf), F.lit(df), F.lit(length), F.lit(1.0))), want)


def test_prior_of_missing_metadata(spark):
    none = F.lit(None)
    assert value(spark, S.unit_prior(none.cast("string"), none.cast("double"), none.cast("string"), none.cast("double"))) == 1.0
    assert math.isclose(value(spark, S.unit_prior(F.lit("coverage_chain"), F.lit(1.0), F.lit("primary"), F.lit(0.0))), 0.70)


def test_blocks_are_a_partition_of_lines(spark):
    rows = [("f", 0, "LABEL_1:", None), ("f", 1, "iffy = 1", None), ("f", 2, "if (x)", None), ("f", 3, "}", None), ("f", 4, "}", "9"), ("f", 5, "", None), ("f", 6, "LABEL_2:", None), ("f", 7, "LABEL_3:", None)]
    d = T.split_blocks(spark.createDataFrame(rows, "func string, line_index int, line string, line_ea string"))
    assert {r.line_index: r.bb_id for r in d.collect()} == {0: 0, 1: 0, 2: 0, 4: 1, 5: 1, 6: 2, 7: 3}


def test_labels(spark):
    rows = ["... ANSWER: HOST_MATCH", "ANSWER: I", "INLINE_MATCH or NO_MATCH", "", None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", T.parse_label(F.col("t")).alias("l"))
    assert [r.l for r in d.orderBy("i").collect()] == [1, 2, 0, None, None]


def test_auc_of_swapped_labels_adds_to_one_and_one_class_has_none(spark):
    s = spark.createDataFrame([(0, 0.1, 1), (0, 0.1, 0), (0, 0.7, 1), (0, 0.3, 0), (1, 0.5, 1)], "g int, score double, label int")
    a = {r.g: r.auc for r in E.roc_auc(s, [["g"]]).collect()}
    b = {r.g: r.auc for r in E.roc_auc(s.withColumn("label", 1 - F.col("label")), [["g"]]).collect()}
    assert math.isclose(a[0] + b[0], 1) and a[1] is None


@pytest.mark.parametrize("limit", [48, 1])
def test_nearest_same_by_matrix_and_in_blocks(spark, limit):
    left = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(12)], "k long, emb array<double>")
    right = spark.createDataFrame([(i, [float(i % 4), float(i % 2), 0.5]) for i in range(9)], "b int, emb array<double>").repartition(3)
    one = sorted(map(tuple, R.nearest(left, ["k"], right, "b", 3).collect()))
    assert one == sorted(map(tuple, R.nearest(left, ["k"], right, "b", 3, limit=limit).collect())) and len(one) == 36
    assert R.nearest(left, ["k"], right.limit(0), "b", 3).count() == 0 and R.nearest(left.limit(0), ["k"], right, "b", 3, limit=limit).count() == 0


def test_support_has_the_same_bits_in_any_order_of_hits(spark):
    """A sum next to a tie at the sixth digit: function 48 of bucket 15 at sf0.01, whose SQL sums to 0.8965624999999999 in one thread."""
    rows = [(f, p, 15, "var_chain", c, 1.0) for f, cs in enumerate(itertools.permutations((0.07656249999999999, 0.32, 0.5))) for p, c in enumerate(cs)] + [(9, 0, 15, "cover", 0.25, 1.0)]
    hits = spark.createDataFrame(rows, "func_id long, pos int, bucket_id int, slice_kind string, c double, prior double").coalesce(1)
    want = {f: 0.8965624999999999 for f in range(6)} | {9: 0.25}
    assert {r.func_id: r.support for r in R.postings(hits).collect()} == want
    kinds = R.kind_postings(hits).collect()
    assert {r.func_id: r.support for r in kinds} == want and {r.func_id: r.var_support for r in kinds} == want | {9: None}
    assert all(r.cov_support is None for r in kinds)


def test_weighted_mean_falls_back_without_weight(spark):
    u = spark.createDataFrame([(0, [1.0, 0.0], 3.0), (0, [0.0, 1.0], 1.0), (1, [1.0, 0.0], 0.0), (1, [0.0, 1.0], 0.0)], "g int, emb array<double>, w double")
    got = {r.g: [round(x, 6) for x in r.emb] for r in mean_vectors(u, ["g"], "w").collect()}
    assert got == {0: [0.948683, 0.316228], 1: [0.707107, 0.707107]}


def test_queries_without_anchors_keep_their_order(spark):
    cols = "query_id long, func_id long, score double, slice_channel double, global_sim double, slice_score double, binary_name string, func_addr string"
    d = spark.createDataFrame([(q, f, 1 - f / 10, 0.5, 0.5, 0.5, "b", str(f)) for q in (0, 1) for f in (1, 2, 3)], cols)
    pool = spark.createDataFrame([(3, "CALL", "open"), (2, "CONST", "57600")], "func_id long, channel string, token string")
    asked = spark.createDataFrame([(0, "CALL", "open"), (0, "CALL", "unknown")], "query_id long, channel string, token string")
    idf = spark.createDataFrame([("CALL", "open", 2.0), ("CONST", "57600", 2.0)], "channel string, token string, idf double")
    got = {(r.query_id, r.func_id): (r.rank, round(r.dice, 5)) for r in R.promoted(d, pool, asked, idf).collect()}
    assert got == {(0, 3): (1, 1.0), (0, 1): (2, 0.0), (0, 2): (3, 0.0), (1, 1): (1, 0.0), (1, 2): (2, 0.0), (1, 3): (3, 0.0)}


def loop(inv, truth, size):
    """The selection as a plain loop over binaries."""
    chosen = [r for r in inv if (r[0], r[1]) in truth]
    count = {}
    for r in chosen:
        count[r[0]] = count.get(r[0], 0) + 1
    left = {}
    for r in sorted((r for r in inv if (r[0], r[1]) not in truth and r[3] > 8), key=lambda r: int(r[1])):
        left.setdefault(r[0], []).append(r)
    for b in sorted(left):
        if b not in count and len(chosen) < size:
            chosen.append(left[b].pop(0))
            count[b] = 1
    while len(chosen) < size and any(left.values()):
        for b in sorted((b for b in left if left[b]), key=lambda b: (count[b], b)):
            if len(chosen) < size:
                chosen.append(left[b].pop(0))
                count[b] += 1
    return {(r[0], r[1]) for r in chosen}


def test_pool_selection_is_the_loop(spark):
    inv = [(f"b{i % 5}", str(i * 7 % 100), f"n{i % 6}", 20 if i % 4 else 5, 1) for i in range(60)]
    inv = list({(r[0], r[1]): r for r in inv}.values())
    truth = {(r[0], r[1]) for r in inv[:4]}
    df = spark.createDataFrame(inv, "binary_name string, func_addr string, func_name string, n_lines int, n_units int")
    t = spark.createDataFrame([(a, b) for a, b in truth], "binary_name string, func_addr string")
    none = spark.createDataFrame([], "binary_name string, func_name string")
    for size in (6, 11, 25, 59):
        got = {(r.binary_name, r.func_addr) for r in P.select_pool(df, t, none, size).collect()}
        assert got == loop(inv, truth, size), size
