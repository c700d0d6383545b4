"""Types that the contracts of the queries name, and columns of clashing names, for each operator."""

from __future__ import annotations

import gzip
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from kbspark.llm import decontaminate, fingerprint, jaccard, language, mixing, shards, templates, tokens, toxicity, warc

TYPES = {
    "op1_": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op5_": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11_": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op13_": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("start", TYPES)
def test_types(spark, sf_dir, start):
    query = next(f for k, f in entry.queries().items() if k.startswith(start))
    types = dict(query(spark, sf_dir).dtypes)
    for c, t in (x.split() for x in TYPES[start].split(", ")):
        assert types[c] == t, c


INNER = ("__text", "_text", "__k", "_k", "__at", "_at", "_row", "__row", "_slot", "__part", "text2", "h", "n", "w", "x", "bucket", "shard", "score", "fingerprint", "item_id", "id", "runs")


def test_clashing_names(spark, sf_dir):
    rows = [(i, f"the cat and the dog of number {i} sat on a mat with all their friends", "en", "a", i) for i in range(30)] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = docs.select("*", *[F.lit(7).alias(c) for c in INNER])
    bench = spark.createDataFrame([(1, "What is the capital of France? Paris"), (2, "word " * 20)], "item_id bigint, text string")
    m, t = language.fit(docs), toxicity.fit(docs.select("doc_id", "text", (F.col("doc_id") % 2).alias("toxic")).filter("doc_id IS NOT NULL"))

    def same(f, key="doc_id"):
        a, b = f(docs), f(clash)
        columns = [c for c in a.columns if c not in INNER or c in ("score", "fingerprint", "shard", "item_id")]
        assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))

    for f in (lambda d: language.identify(d, m, spans=False), fingerprint.fingerprints, lambda d: toxicity.score(d, t), jaccard.near_copies, templates.drop_recurring_lines,
              shards.shard, lambda d: decontaminate.without_benchmark(d, bench), mixing.mix):
        same(f)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clash, sf_dir)
        assert set(got.columns) >= set(docs.columns), name
        if name != "sharding":
            assert got.columns == clash.columns and (got.filter("__k <> 7").count() == 0), name
    both = decontaminate.matches(docs.withColumnRenamed("doc_id", "item_id"), bench, key="item_id")
    assert both.columns[:2] == ["doc_id", "item_id"]


def test_short_items_are_found_word_by_word(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France? Paris"), (2, "Two words"), (3, ""), (4, "!?")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x y. What is the capital of France? Paris! z"), (2, "What is the capital of Spain? Paris"), (3, "end two, WORDS"), (4, "two"), (5, "words"), (6, None)],
                                 "doc_id bigint, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(1, 1, 1.0), (3, 2, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.without_benchmark(docs, bench).collect()) == [2, 4, 5, 6]


def test_unknown_scripts_are_no_evidence(spark, sf_dir):
    m = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = [("这是一个中文句子",), ("Это русский текст",), ("the dog and the cat are here with you",), ("the dog and the cat Это русский",)]
    got = [r.score for r in language.identify(spark.createDataFrame(rows, "text string"), m).collect()]
    assert got[0] == got[1] == 0 and got[2] > 0.9 and 0.4 < got[3] < 0.7
    assert len(language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), most_languages=2).languages) == 2


def test_salvage_is_linear_in_members():
    one = warc.member(warc._record("response", 1, None, b"x" * 300, __import__("hashlib").sha256(b"x" * 300).hexdigest(), None)) + gzip.compress(b"")
    took = []
    for n in (2000, 8000):
        data, t = one * n, time.perf_counter()
        assert sum("problem" not in r for r in warc.salvage(data)) == n
        took.append(time.perf_counter() - t)
    assert took[1] < 8 * took[0] + 0.5
    half = warc.member(warc._record("response", 2, None, b"y" * 100_000, "", None))
    rows = list(warc.salvage(one + half[:60] + one))
    assert [r.get("problem") for r in rows] == [None, "member does not unpack", None] or [r.get("problem") for r in rows] == [None, "member is cut off", None]


def test_empty_long_and_repeated_pages(spark, tmp_path):
    kinds = "page_id bigint, url string, html string"
    warc.write_archive(spark.createDataFrame([], kinds), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0
    rows = [(1, "u", "z" * 3_000_000), (2, None, "é" * 100), (2, None, "é" * 100), (3, "v", None), (4, "w", "z" * 3_000_000)]
    warc.write_archive(spark.createDataFrame(rows, kinds), str(tmp_path / "some"))
    got = warc.read_archive(spark, str(tmp_path / "some")).select("record_id", "record_type", "payload_bytes", "problem").collect()
    assert sorted((r[0][10:-1], r[1], r[2]) for r in got) == [("1", "response", 3_000_000), ("2", "response", 200), ("2", "response", 200), ("3", "response", 0), ("4", "revisit", 3_000_000)]
