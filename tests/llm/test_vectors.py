"""Top-k and hard negatives over integer vectors against all pairs, with ties, copies, odd vectors and clashing names."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import nra, queries, rtree, vectors

KINDS = "vec_id bigint, embedding array<float>, label int"


def brute_top(rows, k=5, each=50):
    out = []
    for i, (a, x) in enumerate(rows):
        if a % each == 0:
            best = sorted((-int(x @ y), b) for j, (b, y) in enumerate(rows) if j != i and len(y) == len(x))[:k]
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, each=50):
    out = []
    for i, (a, x, label) in enumerate(rows):
        if a % each:
            continue
        scores = [(-int(x @ y), b, j, other) for j, (b, y, other) in enumerate(rows) if j != i and len(x) == len(y)]
        for s, p, _, _ in sorted(t for t in scores if t[3] == label)[:5]:
            fits = sorted(t for t in scores if t[3] != label and 50 * -s <= 100 * -t[0] <= 95 * -s)[:3]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _, _) in enumerate(fits)]
    return sorted(out)


def strange(rng, n=700):
    """Copies, coarse components with many ties, repeated ids, other lengths, and rows that take no part."""
    base = np.round(rng.normal(size=(n, 8)), 1)
    base[200:430] = base[7]
    base[500:520] = 0
    rows = [(i, base[i].tolist(), i % 3) for i in range(n)] + [(50, base[3].tolist(), 1), (50, base[3].tolist(), 1), (100, [1.0, 2.0], 0), (101, [0.5, 0.5], 0), (102, [1.0, 1.0], 1)]
    rows += [(900, None, 1), (950, [], 1), (1000, [None] + [1.0] * 7, 1), (1050, [float("nan")] * 8, 1), (1100, [float("inf")] * 8, 1), (1150, [-float("inf")] * 8, 1),
             (None, base[9].tolist(), 1), (1200, [3e38] * 8, 1), (3, base[3].tolist(), None)]
    return rows


def ints(v):
    return np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)


def of(rows, label):
    good = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and max(map(abs, r[1])) < 65536 and (not label or r[2] is not None)]
    return [(a, ints(v), c) if label else (a, ints(v)) for a, v, c in good]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 800)
    monkeypatch.setattr(vectors, "QUERY_VALUES", 64)


def test_strange_vectors(spark, small_blocks):
    rows = strange(np.random.default_rng(5))
    df = spark.createDataFrame(rows, KINDS).select("*", F.lit(1).alias("id"), F.lit("x").alias("row"), F.lit(2).alias("score")).repartition(5)
    assert sorted(map(tuple, nra.top_k(df, F.col("id") % 50 == 0).collect())) == brute_top(of(rows, False))
    got = rtree.hard_negatives(df, F.col("id") % 50 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == brute_negatives(of(rows, True))


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.uniform(-60_000, 60_000, 4).tolist(), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, KINDS)
    assert sorted(map(tuple, nra.top_k(df, F.col("id") % 50 == 0).collect())) == brute_top(of(rows, False))
    assert sorted(map(tuple, rtree.hard_negatives(df, F.col("id") % 50 == 0, F.col("label")).collect())) == brute_negatives(of(rows, True))


def test_none_alone_and_few(spark):
    empty = spark.createDataFrame([], KINDS)
    assert nra.top_k(empty, F.col("id") % 50 == 0).count() == 0 and rtree.hard_negatives(empty, F.col("id") % 50 == 0, F.col("label")).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1)], KINDS)
    assert nra.top_k(one, F.col("id") % 50 == 0).count() == 0 and rtree.hard_negatives(one, F.col("id") % 50 == 0, F.col("label")).count() == 0
    two = spark.createDataFrame([(50, [1.0, 2.0], 1), (51, [1.0, 1.0], 1)], KINDS)
    assert [tuple(r) for r in nra.top_k(two, F.col("id") % 50 == 0).collect()] == [(50, 1, 51, 256 * 768)]


def test_reading_stops_early_where_lists_tell():
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(4000, 6)) * np.array([200, 5, 5, 5, 5, 5]))
    lists = nra.Lists(v, np.argsort(-v.T, axis=1, kind="stable"))
    q = np.array([100, 1, -1, 2, 0, 1.0])
    left, read = lists.top(q, 5, -np.inf, None)
    assert set(np.argsort(-(v @ q), kind="stable")[:5]) <= set(left) and len(left) <= 125 and read < 0.6 * v.size
    assert lists.top(q, 5, (v @ q).max() + 1, None)[0].size == 0 or lists.top(q, 5, (v @ q).max() + 1, None)[1] <= read


def test_boxes_are_pruned():
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(c, 3, (640, 4)) for c in (-300, -100, 100, 300)]).round().astype("<i4")
    order = rtree.str_order(v)
    assert sorted(order.tolist()) == list(range(len(v)))
    import pyarrow as pa

    n = len(v)
    block = pa.table({"rows": [np.arange(n).astype("<i8").tobytes()], "ids": [np.arange(n).astype("<i8").tobytes()], "labels": [(np.arange(n) % 2).astype("<i8").tobytes()],
                      "v": [v[order].tobytes()], "leaves": [np.full(n // rtree.LEAF, rtree.LEAF, "<i4").tobytes()]})
    tree = rtree.Tree(block, 4, 1000)
    q = np.array([1.0, 1, 1, 1])
    found, read = tree.search(q, -1, 0, False, [(300, 500), (-rtree.ANY, rtree.ANY)], 3)
    s, odd = v[order] @ q, np.arange(n) % 2 == 1
    for w, (lo, hi) in zip(found, ((300, 500), (-1e18, 1e18))):
        assert w == sorted((-int(x), i, i) for i, x in enumerate(s) if odd[i] and lo <= x <= hi)[:3]
    assert 0 < read <= 25 < len(tree.low)


@pytest.mark.parametrize("name", ["op12_topk_inner_product", "op13_hard_negatives"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_equal_their_sql(spark, name, sf):
    got = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = db.execute(queries.CHECKS[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall()) and set(got.columns) == set(columns)
    assert {t for c, t in got.dtypes if c != "rank"} == {"bigint"} and dict(got.dtypes)["rank"] == "int"
