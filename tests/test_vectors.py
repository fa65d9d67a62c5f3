"""Exact and indexed vector search against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import ivf, retrieval
from lodestar.operators import vectors as V
from lodestar.operators.store import Store

KIND = "id bigint, vector array<float>, kind string"


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in row], f"k{i % 2}") for i, row in enumerate(matrix.astype(np.float32))] + [(10**6, None, "k0")], KIND).repartition(3)


def plain(matrix, asked, k, only=None):
    m = matrix.astype(np.float32).astype(np.float64)
    out = set()
    for q in asked:
        scores = np.round(m @ m[q], 6)
        ids = [i for i in range(len(m)) if only is None or i % 2 == only]
        for rank, i in enumerate(sorted(ids, key=lambda i: (-scores[i], i))[:k], 1):
            out.add((q, i, round(float(scores[i]), 6), rank))
    return out


def clustered(n, centres, dim=16, seed=3):
    random = np.random.default_rng(seed)
    matrix = random.standard_normal((centres, dim))[random.integers(0, centres, n)] + 0.15 * random.standard_normal((n, dim))
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def asked_of(v, ids):
    return v.where(F.col("id").isin(ids)).select(F.col("id").alias("query_id"), "vector")


@pytest.mark.parametrize("one_pass", [10, 100])
def test_exact_search(spark, monkeypatch, one_pass):
    for name, value in (("VECTORS", 37), ("QUERIES", 7), ("HELD", 50)):
        monkeypatch.setattr(V, name, value)
    matrix = clustered(300, 9)
    matrix[50:60] = matrix[5]  # ties
    v, ids = frame(spark, matrix), list(range(0, 300, 15))
    got = {tuple(r) for r in retrieval.dense_top(v, asked_of(v, ids), 6, one_pass).select("query_id", "id", "score", "rank").collect()}
    assert got == plain(matrix, ids, 6)
    assert retrieval.dense_top(v, asked_of(v, []), 6, one_pass).collect() == []


def test_best_of_parts_with_ties():
    """The best of any parts are the best of all, with ties, close scores and scores that are not numbers."""
    random = np.random.default_rng(4)
    for k in (1, 3, 10):
        scores = np.round(random.standard_normal((7, 400)), 1) + random.choice([0, 4e-7, -4e-7], (7, 400))
        scores[0, :] = 0.5
        scores[1, 5:390] = np.nan
        ids = random.permutation(400)
        best = V.Best(k)
        for at in [0, 2, 9, 150, 399]:
            part = slice(at, {0: 2, 2: 9, 9: 150, 150: 399, 399: 400}[at])
            best.add(np.arange(7), ids[part], scores[:, part])
        assert best.size == 7 * k
        got = [x for b in best.rows() for x in zip(*(b.column(c).to_pylist() for c in ("query_id", "id")), strict=True)]
        rounded = np.round(scores, V.DIGITS)
        assert got == [(q, int(ids[i])) for q in range(7) for i in sorted(range(400), key=lambda i: (np.isnan(rounded[q, i]), -np.nan_to_num(rounded[q, i]), ids[i]))[:k]]


def test_vectors_of_one_file_are_dealt_over_all_cores(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "id bigint, vector array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<float>")
    assert V.candidates(v, asked, 1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_packs_keep_keys_apart(spark):
    rows = spark.createDataFrame([(i, [float(i)], i // 5) for i in range(23)], "id bigint, vector array<double>, g int").coalesce(1)
    got = [(r["g"], r["n"], np.frombuffer(r["ids"], "<i8").tolist(), np.frombuffer(r["matrix"], "<f8").tolist()) for r in V.packed(rows, 3, ("g",)).collect()]
    assert [(g, n) for g, n, _, _ in got] == [(0, 3), (0, 2), (1, 3), (1, 2), (2, 3), (2, 2), (3, 3), (3, 2), (4, 3)]
    assert [i for _, _, ids, _ in got for i in ids] == list(range(23)) and [x for *_, m in got for x in m] == [float(i) for i in range(23)]


def recall(spark, matrix, tmp_path, k=10):
    v, ids = frame(spark, matrix), list(range(0, len(matrix), 20))
    store = Store(spark, str(tmp_path))
    held = ivf.ensured(store, v.select("id", "vector"))
    found = {(r["query_id"], r["id"]) for r in ivf.search(held, asked_of(v, ids), k).collect()}
    want = {(q, i) for q, i, _, _ in plain(matrix, ids, k)}
    looked = ivf.looked_at(held, asked_of(v, ids)).agg(F.avg("n")).first()[0]
    assert held.read("lists").agg(F.sum("n")).first()[0] == len(matrix)
    return len(found & want) / len(want), looked / len(matrix), held


@pytest.mark.parametrize("n", [800, 4000])
def test_clusters_need_few_cells(spark, tmp_path, n):
    found, looked, _ = recall(spark, clustered(n, n // 20), tmp_path)
    assert found >= 0.9 and looked < 0.1


def test_vectors_without_structure_need_many(spark, tmp_path):
    random = np.random.default_rng(9).standard_normal((600, 32))
    found, looked, held = recall(spark, random / np.linalg.norm(random, axis=1, keepdims=True), tmp_path)
    assert found >= 0.9 and looked > 0.3 and ivf.quantiser_of(held).probes > 5


def test_facets_and_one_crowded_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "VECTORS", 16)
    matrix = clustered(300, 6)
    matrix[100:250] = matrix[0]
    v, ids = frame(spark, matrix), [0, 20, 40, 280]
    store = Store(spark, str(tmp_path))
    held = store.publish(ivf.build(v, store))
    every = len(ivf.quantiser_of(held).centroids)
    got = {tuple(r) for r in ivf.search(held, asked_of(v, ids), 5, where=F.col("kind") == "k1", probes=every).select("query_id", "id", "score", "rank").collect()}
    assert got == plain(matrix, ids, 5, only=1)
    assert held.read("lists").agg(F.max("n")).first()[0] <= 16


def test_life_cycle(spark, tmp_path):
    v = frame(spark, clustered(60, 3)).select("id", "vector")
    store = Store(spark, str(tmp_path))
    before = ivf.ensured(store, v)
    assert ivf.ensured(store, v) .number == before.number  # there already
    after = store.publish(ivf.build(v.where("id < 30"), store), base=before)
    assert [s.read("lists").agg(F.sum("n")).first()[0] for s in (before, after)] == [60, 30]
    store.sweep(0)
    assert after.read("lists").count() > 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        before.read("lists").count()


def test_nothing_to_index(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    held = store.publish(ivf.build(spark.createDataFrame([], "id bigint, vector array<float>"), store))
    assert ivf.search(held, spark.createDataFrame([], "query_id bigint, vector array<float>"), 3).collect() == []
