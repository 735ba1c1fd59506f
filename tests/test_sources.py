import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitloom.operators import retrieval, training
from unitloom.sources import tables


def test_cases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"description": "d", "num_queries": 2, "cases": [{"cve_id": "a", "gt_addr": "0x1"}, {"cve_id": "b", "gt_type": "leaf"}]}, indent=1))
    assert [(r.cve_id, r.gt_addr, r.gt_type) for r in tables.read_cases(spark, f"file://{tmp_path}/c.json").orderBy("cve_id").collect()] == [("a", "0x1", None), ("b", None, "leaf")]


def test_features_skip_what_does_not_parse(spark, tmp_path):
    good = {"0x10": {"func_addr": "0x10", "func_name": "f", "lines": [{"line": "x;", "line_index": 0, "line_ea": None}]}}
    (tmp_path / "lib_bb_slice_feature.json").write_text(json.dumps(good))
    (tmp_path / "bad_feature.json").write_text("{ not json")
    rows = tables.read_features(spark, f"file://{tmp_path}/*_feature.json").collect()
    assert [(r.binary_name, r.addr, r.func_name, r.lines[0].line) for r in rows] == [("lib", "0x10", "f", "x;")]


def test_table_set_round_trip_and_version(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/set"
    assert tables.read_tables(spark, at) is None
    tables.write_tables({"a": spark.range(3), "b": spark.range(2)}, at)
    assert {k: v.count() for k, v in tables.read_tables(spark, at).items()} == {"a": 3, "b": 2}
    monkeypatch.setattr(tables, "VERSION", 2)
    assert tables.read_tables(spark, at) is None


def test_discovery(spark):
    p = spark.createDataFrame([("/p/b",), ("/p/a",), ("/p/a",), ("/p/a.json",), ("/p/x_srccode/a",)], "path string")
    assert [r.path for r in tables.discover_binaries(p).collect()] == ["/p/a", "/p/b"]


def test_classifier_errors_match_nothing(spark):
    p = spark.createDataFrame([(1, 2, "a", "b")], "query_id long, func_id long, q_text string, c_text string")

    def broken(q, c):
        raise OSError

    assert tables.classified(p, broken).first().answer == "error: OSError"


def test_centroids_by_both_metrics(spark):
    u = spark.range(60).select(F.col("id").alias("func_id"), F.lit(0).alias("pos"), F.array(*[F.when(F.col("id") % 3 == i, 1.0).otherwise(0.01) for i in range(3)]).alias("emb"))
    for metric in ("ip", "l2"):
        c = training.centroids(u, 3, 60, metric).collect()
        assert len(c) == 3 and sorted(max(range(3), key=lambda i, r=r: r.emb[i]) for r in c) == [0, 1, 2]
    assert training.transform(u, 2).select(F.size("emb").alias("n")).first().n == 2


def test_results_are_written_as_json(spark, tmp_path):
    m = spark.createDataFrame([(None, 2, 0.5), (1, 1, 1.0)], "gt_type int, queries long, recall_1 double")
    d = spark.createDataFrame([(1, "x")], "query_id long, miss_reason string")
    tables.write_results(str(tmp_path), m, d, d)
    rows = [json.loads(line) for f in (tmp_path / "metrics").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(rows, key=str) == sorted([{"gt_type": None, "queries": 2, "recall_1": 0.5}, {"gt_type": 1, "queries": 1, "recall_1": 1.0}], key=str)
    assert {p.name for p in tmp_path.iterdir()} == {"metrics", "misses", "details"}


def test_index_needs_a_row_for_each_vector(spark, tmp_path):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, emb array<double>")
    m = spark.createDataFrame([(0, "a"), (1, "b")], "vec_id long, func string")
    tables.write_index(f"file://{tmp_path}/x", v, m)
    assert {k: t.count() for k, t in tables.read_tables(spark, f"file://{tmp_path}/x").items()} == {"vectors": 2, "meta": 2}
    for bad in (m.where("vec_id = 0"), m.replace("a", "c").withColumn("vec_id", F.col("vec_id") + 1)):
        with pytest.raises(ValueError):
            tables.write_index(f"file://{tmp_path}/y", v, bad)


def test_table_set_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"t": spark.range(3)}

    for _ in range(2):
        assert tables.built_once(spark, f"file://{tmp_path}/z", build)["t"].count() == 3
    assert calls == [1]


def test_trained_index_finds_near_units(spark):
    """Recall of the nearest unit among those that share a bucket, against all units."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = spark.createDataFrame([(i // 4, i % 4, v.tolist()) for i, v in enumerate(x)], "func_id long, pos int, emb array<double>")
    c = training.centroids(u, 32, training.train_size(400, 32))
    near = retrieval.nearest(u, ["func_id", "pos"], c, "bucket_id", 8).collect()
    buckets = {}
    for r in near:
        buckets.setdefault(r.func_id * 4 + r.pos, set()).add(r.bucket_id)
    sims = x @ x.T - 2 * np.eye(400)
    assert np.mean([bool(buckets[i] & buckets[int(sims[i].argmax())]) for i in range(400)]) >= 0.9
