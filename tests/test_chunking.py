"""Edge frames and invariants of sections and chunks."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from kbspark.functions.scalars import regex_token_count, token_count
from kbspark.functions import scalars
from kbspark.operators import chunking as K


def secs(spark, text):
    df = spark.createDataFrame([("d", text)], "doc_code string, text string")
    return [(list(r["hierarchy"]), r["content"]) for r in K.section_rows(df).orderBy("section_no").collect()]


def test_sections_edges(spark):
    assert secs(spark, "") == [([], "")]
    assert secs(spark, "  \n ") == [([], "")]
    assert secs(spark, "plain\ntext") == [([], "plain\ntext")]
    assert secs(spark, "intro\n# A\nx\n#### D\ny\n## B\nz") == [
        ([], "intro"), (["A"], "x"), (["A", "", "", "D"], "y"), (["A", "B"], "z")]
    assert secs(spark, "# A\n# B\nbody") == [(["B"], "body")]
    assert secs(spark, "# only heading") == [([], "# only heading")]
    assert secs(spark, "# A\n[[PAGE:3]]") == [(["A"], "[[PAGE:3]]")]
    assert secs(spark, "# A [[PAGE:2]]\nx") == [([], "# A [[PAGE:2]]\nx")]
    assert secs(spark, "####### seven\n#nospace") == [([], "####### seven\n#nospace")]


def test_sections_of_a_long_document():
    lines = []
    for i in range(250_000):
        lines += [f"{'#' * (1 + i % 6)} Part {i}", f"line {i}", "", "more"]
    t0 = time.perf_counter()
    found = K.sections_of("\n".join(lines))
    assert len(lines) == 1_000_000 and len(found) == 250_000 and time.perf_counter() - t0 < 30
    assert found[6] == (["Part 6"], "line 6\n\nmore") and found[11] == ([f"Part {i}" for i in range(6, 12)], "line 11\n\nmore")
    assert K.sections_of(None) == [([], None)]


def test_split_covers_text_and_moves_on():
    text = " ".join(f"w{i}" for i in range(4000))
    for overlap in (0, 20, 90):
        parts = K.split_at_boundaries(text, 100, overlap, 130)
        pos = 0
        for p in parts:
            at = text.index(p)
            assert at <= pos + 1
            pos = max(pos, at + len(p))
        assert pos == len(text)


def test_split_edges():
    assert K.split_at_boundaries("", 10, 2, 12) == []
    assert K.split_at_boundaries("  \n", 10, 2, 12) == []
    assert K.split_at_boundaries("short", 10, 2, 12) == ["short"]
    assert K.split_at_boundaries("x" * 30000, 10, 2, 12) == ["x" * 30000]  # a token is never cut
    parts = K.split_at_boundaries("a b c. " * 10 + "Stop! " + "d e f " * 100, 20, 0, 45)
    assert all(len(scalars.token_ends(p)) <= 45 for p in parts)
    assert parts[0].endswith("Stop!")
    assert K.split_at_boundaries("a b c d e f g h", 0, 0, 0)  # a zero budget still moves forward


def test_chunk_invariants(spark, hot_rows):
    body = "\n".join(f"Sentence number {i} of the text; it goes on." for i in range(900))
    rows = [("d1", f"# Top\n[[PAGE:1]]\n{body}\n## Sub\n[[PAGE:2]]\n{body}"), ("d2", ""), ("d3", "tiny")]
    df = spark.createDataFrame(rows, "doc_code string, text string")
    ch = K.chunk_documents(df).cache()
    assert {r[0] for r in ch.select("doc_code").distinct().collect()} == {"d1", "d3"}
    assert ch.count() == ch.select("chunk_id").distinct().count()
    fine = ch.filter("chunk_type = 'FINE'").alias("f")
    coarse = ch.filter("chunk_type = 'COARSE'").select(F.col("chunk_id").alias("pid"), F.col("content").alias("pcontent"))
    pairs = fine.join(coarse, F.col("parent_chunk_id") == F.col("pid"))
    assert pairs.count() == fine.count()
    body = F.element_at(F.split("content", "\n\n", 2), -1)
    assert pairs.filter(~F.contains("pcontent", body)).count() == 0
    for t in ("FINE", "COARSE"):
        one = {r["chunk_id"]: r for r in ch.filter((F.col("doc_code") == "d1") & (F.col("chunk_type") == t)).collect()}
        heads = [r for r in one.values() if r["prev_chunk_id"] is None]
        assert len(heads) == 1
        seen, cur = 0, heads[0]
        while cur is not None:
            seen, cur = seen + 1, one.get(cur["next_chunk_id"])
        assert seen == len(one)
    linked = K.link_chunks(fine.select("doc_code", "chunk_id", "chunk_index", F.col("prev_chunk_id").alias("p"), F.col("next_chunk_id").alias("n")))
    assert linked.filter(~F.col("p").eqNullSafe(F.col("prev_chunk_id")) | ~F.col("n").eqNullSafe(F.col("next_chunk_id"))).count() == 0
    again = K.chunk_documents(df.repartition(7, F.rand()))
    assert again.exceptAll(ch).count() == 0 and ch.exceptAll(again).count() == 0


def test_long_title_and_custom_counter(spark):
    title = "word " * 600
    df = spark.createDataFrame([("d", f"# {title}\nbody one; body two")], "doc_code string, text string")
    assert K.chunk_documents(df).count() >= 2
    by_char = K.chunk_documents(df, ends=lambda t: list(range(1, len(t) + 1)))
    assert by_char.filter(F.col("token_size") != F.length("content")).count() == 0


def test_token_counter_agrees_with_builtin(spark):
    texts = ["", "Hello, world!", "中文 混排 text", "a_b c-d", "éà ü ñ", "日本語テスト123", "x\t\n y", "№5 ½ — “q”", "éa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_count("t").alias("n"))
    for r in df.collect():
        assert r["n"] == regex_token_count(r["t"]), r["t"]


def test_upload_above_the_limit_is_refused_and_others_are_chunked_whole(spark):
    from kbspark.plans import ingest

    rows = [("big", "a.md", 5000, "1", "P", "One sentence here. " * 250), ("small", "b.md", 40, "1", "P", "One sentence here."), ("empty", "c.md", 0, "1", "P", "")]
    up = spark.createDataFrame(rows, "doc_code string, file_name string, file_size bigint, tenant_code string, system_type string, content string")
    low = {r["doc_code"]: (r["status"], r["error_message"]) for r in ingest.ingest_status(up, ingest.ingest_chunks(up, 1000), 1000).collect()}
    assert low["big"] == ("FAILED", "file exceeds 0 MB") and low["small"] == ("SUCCESS", None) and low["empty"][0] == "FAILED"
    all_in = {r["doc_code"]: r["status"] for r in ingest.ingest_status(up, ingest.ingest_chunks(up)).collect()}
    assert all_in == {"big": "SUCCESS", "small": "SUCCESS", "empty": "FAILED"}


def test_texts_are_taken_by_slices(spark, monkeypatch):
    """What Python holds of a batch of texts is a slice of bounded size, with the same sections and chunks."""
    import pyarrow as pa

    made = K._record_batch

    def small(rows, schema):
        if len({r[0] for r in rows}) > 3:
            raise ValueError("more than a slice of documents at a time")
        return made(rows, schema)

    rows = [(f"D{i}", f"# T{i}\n" + "word. " * 60 + "\n## U\n\nend") for i in range(200)] + [("long", "# L\n" + "word. " * 3000), ("none", None), ("blank", " \n")]
    docs = spark.createDataFrame(rows, "doc_code string, text string").coalesce(1)
    order = lambda df: sorted(map(str, df.collect()))
    want = order(K.chunk_documents(docs)), order(K.section_rows(docs))
    monkeypatch.setattr(K, "SLICE", 1000)
    monkeypatch.setattr(K, "_record_batch", small)
    assert (order(K.chunk_documents(docs)), order(K.section_rows(docs))) == want
    texts = pa.array([t for _, t in rows])
    cut = list(K._slices(texts))
    assert sum(n for _, n in cut) == len(rows) and [b for b, _ in cut] == [sum(n for _, n in cut[:i]) for i in range(len(cut))]
    assert all(n == 1 or sum(len(t or "") for t in texts.slice(b, n).to_pylist()) <= 1000 for b, n in cut)
