"""Stages of the pipeline on repeated rows and empty tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import common, decontaminate, language, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_equal_rows_meet_their_target(spark, sf_dir):
    rows = [(1, "a b c d e f g h", "en", "x", 0)] * 1000 + [(i, "one two " * (i % 7), "en", "y", 0) for i in range(2, 300)] + [(None, None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, DOCS)
    want = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).selectExpr("doc_id", "size", "copies").groupBy("doc_id", "size").sum("copies").withColumnRenamed("sum(copies)", "taken").collect()}
    got = {(r.doc_id, len((r.text or "").split())): r["count"] for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).groupBy("doc_id", "text").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_empty_table(spark, sf_dir):
    none = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name


def test_documents_travel_in_small_batches(spark, sf_dir, monkeypatch):
    def sizes(docs, *_, **__):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")

    def learned(labelled):
        assert sizes(labelled).agg(F.max("n")).first()[0] <= 1024

    def identified(docs, *_, **__):
        return sizes(docs).select(F.struct("n").alias("doc"), F.lit("en").alias("lang_pred"), F.lit(1.0).alias("score"))

    monkeypatch.setattr(decontaminate, "without_benchmark", sizes)
    monkeypatch.setattr(language, "fit", learned)
    monkeypatch.setattr(language, "identify", identified)
    docs, before = spark.range(6000).selectExpr("id AS doc_id", "'a text' AS text").coalesce(1), spark.conf.get(common.BATCH_ROWS)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_benchmark_leaks):
        got = [r.n for r in stage(spark, docs, sf_dir).collect()]
        assert sum(got) == 6000 and max(got) <= 1024
    assert spark.conf.get(common.BATCH_ROWS) == before
