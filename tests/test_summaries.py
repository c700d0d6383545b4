"""Summaries of documents from their chunk rows."""

from __future__ import annotations

import random

from kbspark.operators import maintenance as M


def test_rows_of_a_document_meet_before_the_sort(spark, monkeypatch):
    """The wide rows are not sorted where they are read; documents of many ranges of chunk numbers, null numbers and equal rows give their best row."""
    monkeypatch.setattr(M, "INDEX_CELL", 4)
    r = random.Random(5)
    rows = [(f"d{r.randrange(12)}", r.choice([None, -2, -1, *range(40)]), r.choice(["FINE", "FINE", "COARSE"]), f"k{i % 190:03d}", r.choice(["t", None]), f"n{i % 190}") for i in range(400)]
    rows += rows[:20]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_type string, chunk_id string, tenant_code string, file_name string").repartition(3)
    found = M.document_summaries(chunks, ["file_name", "tenant_code"])
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    deepest = max(i for i, x in enumerate(plan) if "SortAggregate" in x)
    assert any("Exchange hashpartitioning(document_id" in x for x in plan[deepest:])

    def rank(x):
        fine = x[1] is not None and x[1] >= 0 and x[2] != "COARSE"
        return (0 if fine else 1 if x[1] == -1 else 2, x[1] is not None, x[1] or 0, x[3])

    want = {}
    for x in rows:
        want.setdefault(x[0], []).append(x)
    got = {x["document_id"]: (x["chunk_count"], x["file_name"]) for x in found.collect()}
    assert got == {d: (sum(rank(x)[0] == 0 for x in of), min(of, key=rank)[5]) for d, of in want.items()}


def test_missing_documents_need_the_codes_alone(spark):
    """A document with several rows in the table, or a label beside it, is there once; one without a code is never missing."""
    kinds = "document_id string, doc_code string, tenant_code string, system_type string, file_name string, title string, file_size bigint, status string, chunk_count bigint"
    summaries = spark.createDataFrame([("a", "A", None, "s", "f", None, None, None, 2), ("b", "B", "1", "s", "f", "t", 1, "FAILED", 1), ("c", None, "1", "s", "f", "t", 1, "FAILED", 1)], kinds)
    documents = spark.createDataFrame([("B",), ("B",), (None,)], "doc_code string")
    labels = spark.createDataFrame([("B", 1), ("B", 2)], "code string, label int")
    joined = documents.join(labels, documents["doc_code"] == labels["code"], "left")
    found = M.missing_documents(summaries, joined)
    assert [tuple(x) for x in found.collect()] == [("a", "A", "default", "s", "f", "f", 0, "SUCCESS", 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
