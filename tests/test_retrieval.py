"""Vector recall against brute force, re-ranking rules and context rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.functions.text import topics_overlap, with_query_variants
from kbspark.operators import retrieval as R

CH = "chunk_id string, tenant_code string, system_type string, enabled boolean, status string, embedding array<float>"
QU = "query_id bigint, query_pos int, tenant_code string, system_type string, embedding array<double>"


def data(spark, n=400, m=12, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    ch = [(f"c{i:05d}", "0" if i % 3 == 0 else str(i % 4), f"s{i % 2}", i % 10 != 0, "SUCCESS" if i % 7 else "FAILED",
           [float(x) for x in np.float32(rng.normal(size=dim))]) for i in range(n)]
    ch += [(f"z{i}", "0", "s0", True, "SUCCESS", [float(x) for x in np.float32(np.ones(dim))]) for i in range(30)]
    ch.append(("zero", "0", "s0", True, "SUCCESS", [0.0] * dim))
    qs = [(i, 0, str(i % 4), f"s{i % 2}", [float(x) for x in rng.normal(size=dim)]) for i in range(m)]
    return ch, qs


def brute(ch, qs, k, scope):
    out = set()
    for q in qs:
        hits = []
        for c in ch:
            seen = c[1] in (q[2], "0") or (scope == "admin_all" and q[2] == "0")
            if c[3] and c[4] == "SUCCESS" and c[2] == q[3] and seen:
                a, b = np.array(c[5], dtype=float), np.array(q[4])
                d = np.linalg.norm(a) * np.linalg.norm(b)
                cos = a @ b / d if d else 0.0
                s = round((1 + cos) / 2, 6)
                hits.append((-s, c[0]))
        out |= {(q[0], c, -s, i + 1) for i, (s, c) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize("scope", ["strict", "admin_all"])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_recall_equals_brute_force(spark, scope, limit, monkeypatch):
    ch, qs = data(spark)
    blocked = R._blocked
    monkeypatch.setattr(R, "_blocked", lambda *a: blocked(*a, block_chunks=40, block_queries=2))
    hits = R.vector_recall(spark.createDataFrame(ch, CH).repartition(5), spark.createDataFrame(qs, QU), k=6, scope=scope, broadcast_bytes=limit)
    got = {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in hits.collect()}
    assert got == brute(ch, qs, 6, scope)


@pytest.mark.parametrize("size", [0, 1 << 30])
def test_vectors_that_cannot_be_compared_are_listed(spark, size):
    """A wrong vector neither ends the job nor changes the others' hits; it is returned with a reason."""
    ch, qs = data(spark, 5, 1)
    n = len(ch[0][5])
    odd = [("bad", "0", "s0", True, "SUCCESS", [1.0, 2.0]), ("nan", "0", "s0", True, "SUCCESS", [float("nan")] * n), ("none", "0", "s0", True, "SUCCESS", None)]
    hits = lambda rows: sorted(map(tuple, R.vector_recall(spark.createDataFrame(rows, CH), spark.createDataFrame(qs, QU), broadcast_bytes=size).collect()))
    assert hits(ch + odd) == hits(ch)
    got = {r["chunk_id"]: r["reason"] for r in R.rejected_vectors(spark.createDataFrame(ch + odd, CH), n).collect()}
    assert got == {"bad": f"not of {n} components but 2", "nan": "component is null or not a number", "none": "no vector"}


def test_topic_rule(spark):
    rows = [([], ["a"]), (["a"], []), (["a"], ["a"]), (["a"], ["b"]), (["a", "b"], ["a"]), (["a", "b"], ["a", "b"]),
            (["a", "b", "c"], ["a"]), (["a", "b", "c"], ["a", "c"]), (None, ["x"])]
    df = spark.createDataFrame(rows, "q array<string>, d array<string>")
    assert [r[0] for r in df.select(topics_overlap("q", "d")).collect()] == [True, True, True, False, False, True, False, True, True]


def candidates(spark, rows):
    cols = "query_id bigint, chunk_id string, tenant_code string, doc_tenant string, score double, content string, query_topics array<string>, doc_topics array<string>"
    return spark.createDataFrame([(*r, [], []) for r in rows], cols)


def test_rerank_order_null_scores_and_fallback(spark):
    c = candidates(spark, [(1, "a", "2", "0", 0.95, "x"), (1, "b", "2", "2", 0.90, "x"), (1, "c", "2", "2", None, "x"), (1, "d", "2", "2", 0.5, "x"),
                           (2, "a", "0", "0", 0.9, "x"), (2, "b", "0", "3", 0.95, " "), (3, "a", "1", "1", 0.9, "x")])
    scores = spark.createDataFrame([(2, "a", 0.9), (2, "b", 0.99), (2, "gone", 0.99), (3, "a", 0.1)], "query_id bigint, chunk_id string, rerank_score double")
    got = [(r["query_id"], r["chunk_id"], r["source"]) for r in R.rerank(c, scores, 5, 0.0).orderBy("query_id", "position").collect()]
    # own tenant first for question 1; blank and unknown texts leave question 2; question 3 was answered with nothing good enough
    assert got == [(1, "b", "local"), (1, "c", "local"), (1, "a", "local"), (2, "a", "external")]


def test_threshold_floor_and_minimum_rows(spark):
    c = candidates(spark, [(1, "a", "2", "0", 0.84, "x"), (1, "b", "2", "2", 0.86, "x"), (1, "c", "2", "2", 0.99, "x")])
    assert [r["chunk_id"] for r in R.local_rerank(c, 0, 0.5).collect()] == ["c"]
    assert R.local_rerank(c, 9, 0.5).count() == 2
    assert R.local_rerank(c, 9, 0.5, floor=0.0).count() == 3


def test_merge_variants_first_and_best(spark):
    hits = spark.createDataFrame([(1, 0, "a", 0.3), (1, 1, "a", 0.9), (1, 1, "b", 0.5)], "query_id bigint, query_pos int, chunk_id string, score double")
    ch = spark.createDataFrame([("a", "D", 1), ("b", "D", 2)], "chunk_id string, doc_code string, chunk_index int")
    pick = lambda keep: {(r["chunk_id"], r["score"]) for r in R.merge_variants(hits, ch, keep).collect()}
    assert pick("first") == {("a", 0.3), ("b", 0.5)}
    assert pick("best") == {("a", 0.9), ("b", 0.5)}


def test_graph_context_cut(spark):
    p = spark.createDataFrame([(1, 1, "s", "x" * 7000), (1, 2, "s", None)], "query_id bigint, rank int, source_content string, other_content string")
    g = R.graph_context(p, 6000).first()["graph_context"]
    assert g.startswith("s\n***\nx") and g.endswith("(graph context cut)") and len(g) > 6000
    assert R.graph_context(p, 10000).first()["graph_context"] == R.graph_context(p).first()["graph_context"] == "s\n***\n" + "x" * 7000


def test_scorer_plug_in(spark):
    c = candidates(spark, [(1, "a", "2", "0", 0.9, "long text"), (1, "b", "2", "0", 0.9, "  ")]).withColumn("question", F.lit("q"))
    s = R.score_candidates(c, lambda qs, ts: [len(t) / 10 for t in ts]).collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in s] == [("a", 0.9)]


def test_query_variants_edges(spark):
    df = spark.createDataFrame([("",), ("   ",), ("Please?",), ("Please, what is the travel policy, thanks!",), ("alpha",)], "question string")
    got = [r["variants"] for r in with_query_variants(df).collect()]
    assert got[0] == [""] and got[1] == ["   "]
    assert got[2][0] == "Please?"
    assert got[3][0] == "what is the travel policy"
    assert got[4] == ["alpha"]
