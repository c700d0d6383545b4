"""The versioned chunk store and pruned recall from it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import pruned
from kbspark.operators.retrieval import vector_recall
from kbspark.sources import store as S

ROWS = "chunk_id string, tenant_code string, system_type string, chunk_type string, content string, embedding array<float>, enabled boolean, status string"


def row(i, tenant="1", system="a", kind="FINE", text=None, v=None, enabled=True):
    return (f"c{i:04d}", tenant, system, kind, text or f"text {i}", v, enabled, "SUCCESS")


def contents(store, version=None):
    return {r.chunk_id: (r.tenant_code, r.system_type, r.content, None if r.embedding is None else tuple(r.embedding)) for r in store.read(version).collect()}


def test_upsert_versions_and_embedding(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        assert len(texts) <= 16
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    store = S.ChunkStore(spark, str(tmp_path / "s"))
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.read()
    first = [row(i, "01" if i % 3 else "02", "a/b" if i % 2 else "c=d") for i in range(40)] + [row(99, "01", "a/b", "COARSE")]
    df = spark.createDataFrame(first, ROWS)
    assert store.upsert(df, embedder) == 1 and calls.value == 40
    assert contents(store)["c0001"] == ("01", "a/b", "text 1", (6.0, 1.0)) and contents(store)["c0099"][3] is None
    assert store.upsert(df, embedder) == 1 and calls.value == 40  # a rerun changes nothing
    folders = {(t, s): f for t, s, f in store.live()}
    second = [row(1, "01", "a/b", text="other text"), row(7, "01", "a/b", text="text 7"), row(99, "01", "a/b", "COARSE", text="not taken"), row(500, "03", None), row(4, "04", "x")]
    assert store.upsert(spark.createDataFrame(second, ROWS), embedder) == 2 and calls.value == 42  # changed text and the new row; 4 moves with its vector
    now = contents(store)
    assert now["c0001"][2:] == ("other text", (10.0, 1.0)) and now["c0099"][2] == "text 99" and now["c0500"][:2] == ("03", None) and now["c0004"][:2] == ("04", "x")
    assert len(now) == 42 and now["c0004"][3] == (6.0, 1.0)
    assert contents(store, 1)["c0001"][2] == "text 1" and len(contents(store, 1)) == 41  # readers of the old version still see it
    after = {(t, s): f for t, s, f in store.live()}
    untouched = {k for k, f in after.items() if f == 1}
    assert untouched and untouched == {k for k in folders if k not in {("01", "a/b"), ("01", "c=d")}}
    assert store.vacuum() == [] and set(contents(store)) == set(now)
    assert {r.reason for r in store.rejected().collect()} == set()
    with pytest.raises(Exception):
        store.upsert(spark.createDataFrame([(None, "1", "a", "FINE", "x", None, True, "SUCCESS")], ROWS))
    assert store.version() == 2


def test_new_columns_and_rejected_vectors(spark, tmp_path):
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([row(1, v=[1.0, 0.0]), row(2, v=[float("nan"), 1.0]), row(3, v=[]), row(4), row(5, v=[1.0, 2.0, 3.0])], ROWS))
    store.upsert(spark.createDataFrame([row(6, v=[0.0, 1.0])], ROWS).withColumn("page", F.lit(3)))
    assert {r.chunk_id: r.page for r in store.read().collect()} == {"c0001": None, "c0002": None, "c0003": None, "c0004": None, "c0005": None, "c0006": 3}
    assert {r.chunk_id: r.reason for r in store.rejected().collect()} == {"c0002": "component is null or not a number", "c0003": "empty vector", "c0004": "no vector"}
    q = spark.createDataFrame([(1, 0, "1", "a", [1.0, 0.1]), (2, 0, "1", "a", [1.0, 1.0, 1.0]), (3, 0, "1", "a", None), (4, 0, "1", "a", [0.0, 0.0])],
                              "query_id bigint, query_pos int, tenant_code string, system_type string, embedding array<double>")
    hits, _ = pruned.recall_from_store(store, q, 5)
    assert sorted((r.query_id, r.chunk_id) for r in hits.collect()) == [(1, "c0001"), (1, "c0006"), (2, "c0005")]  # a vector meets those of its length alone


@pytest.mark.parametrize("scope", ["strict", "admin_all"])
def test_pruned_recall_equals_the_scan(spark, tmp_path, monkeypatch, scope):
    monkeypatch.setattr(S, "CELL_ROWS", 20)
    monkeypatch.setattr(pruned, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 6))
    vectors = centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.05
    vectors[300:500] = vectors[300]  # copies: ties by id
    rows = [row(i, str(rng.integers(0, 4)), "ab"[rng.integers(0, 2)], v=vectors[i].tolist(), enabled=bool(rng.random() > 0.1)) for i in range(1500)]
    chunks = spark.createDataFrame(rows, ROWS)
    queries = spark.createDataFrame([(i, j, str(i % 4), "ab"[i % 2], (vectors[i * 40 + j] + rng.normal(size=6) * 0.02).tolist()) for i in range(8) for j in range(2)],
                                    "query_id bigint, query_pos int, tenant_code string, system_type string, embedding array<double>")
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(chunks)
    hits, report = pruned.recall_from_store(store, queries, 7, 0.5, scope=scope)
    want = vector_recall(chunks, queries, 7, 0.5, scope=scope)
    columns = ["query_id", "query_pos", "chunk_id", "score", "rank"]
    assert sorted(map(tuple, hits.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    total = report.agg(F.sum("cells"), F.sum("cells_read"), F.sum("cells_skipped")).first()
    assert total[0] == total[1] + total[2] and total[2] > 0.6 * total[0]
    plan = store.read(tenants=["1", "0"], systems=["a"])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "tenant_code" in filters and "system_type" in filters and "folder" in filters
    assert all(r.radius < 1.2 for r in store.cells().collect()) and max(r.n for r in store.cells().collect()) <= 20
