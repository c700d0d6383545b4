"""Multi-hop retrieval against brute force, graph build and deletion invariants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import graph as G
from kbspark.operators import maintenance as M
from kbspark.sources.fixtures import view

CH = "chunk_id string, content string, doc_code string, tenant_code string, system_type string, enabled boolean"


def brute(seeds, chunks, mentions, relations, limit):
    by = {c[0]: c for c in chunks}
    edges = sorted(set(relations))
    out = {}
    for q, cid, t, s in seeds:
        vis = lambda c: c[5] and (t == "0" or (c[3] == t and c[4] == s) or c[3] == "0")
        if cid not in by or not vis(by[cid]):
            continue
        for e1 in {e for c, e in mentions if c == cid}:
            reach = {d for a, d in edges if a == e1}
            for i, (a, mid) in enumerate(edges):
                if a == e1:
                    reach |= {d for j, (b, d) in enumerate(edges) if b == mid and j != i}
            for e2 in reach or {None}:
                others = [by[c] for c, e in mentions if e == e2 and e2 is not None and vis(by[c])]
                for o in others or [None]:
                    key = (by[cid][1], e1, e2, o[1] if o else None)
                    rank = (cid, o[0] if o else "")
                    old = out.setdefault(q, {}).get(key)
                    out[q][key] = (min(cid, old[0]), min(rank[1], old[1])) if old else rank
    rows = set()
    for q, found in out.items():
        order = sorted(found, key=lambda k: (found[k][0], k[1], k[0], k[2] or "", found[k][1]))
        rows |= {(q, i + 1, *k) for i, k in enumerate(order[:limit])}
    return rows


@pytest.mark.parametrize("seed,limit", [(1, 5), (2, 30), (3, 3)])
def test_multi_hop_equals_brute_force(spark, seed, limit):
    r = random.Random(seed)
    chunks = [(f"c{i:03d}", f"text {i // 2}", f"d{i % 9}", str(r.randrange(3)), f"s{r.randrange(2)}", r.random() > 0.1) for i in range(60)]
    mentions = sorted({(f"c{r.randrange(60):03d}", f"e{r.randrange(12):02d}") for _ in range(150)})
    relations = sorted({(f"e{r.randrange(12):02d}", f"e{r.randrange(14):02d}") for _ in range(30)} | {("e01", "e01"), ("e01", "e02"), ("e02", "e01")})
    seeds = [(q, f"c{r.randrange(60):03d}", str(q % 3), f"s{q % 2}") for q in range(10) for _ in range(4)]
    got = G.multi_hop(spark.createDataFrame(seeds, "query_id bigint, chunk_id string, tenant_code string, system_type string"),
                      spark.createDataFrame(chunks, CH), spark.createDataFrame(mentions, "chunk_id string, entity_name string"),
                      spark.createDataFrame([(a, b, "x") for a, b in relations], "src string, dst string, type string"), limit)
    assert {tuple(x) for x in got.collect()} == brute(seeds, chunks, mentions, relations, limit)


@pytest.mark.parametrize("few", [-1, 1_000_000], ids=["many-names", "few-names"])
def test_multi_hop_in_rounds_equals_brute_force(spark, monkeypatch, few):
    """Several rounds, both ways to the mentions, chunks without text or mentions, rows that come twice."""
    monkeypatch.setattr(G, "FEW_NAMES", few)
    monkeypatch.setattr(G, "FIRST_STEPS", 2)
    r = random.Random(4)
    chunks = [(f"c{i:03d}", f"text {i // 3}", "d", str(r.randrange(3)), f"s{r.randrange(2)}", r.random() > 0.1) for i in range(60)]
    mentions = sorted({(f"c{r.randrange(50):03d}", f"e{r.randrange(12):02d}") for _ in range(110)})
    relations = sorted({(f"e{r.randrange(12):02d}", f"e{r.randrange(14):02d}") for _ in range(20)})
    seeds = [(q, f"c{r.randrange(60):03d}", str(q % 3), f"s{q % 2}") for q in range(8) for _ in range(4)]
    got = G.multi_hop(spark.createDataFrame(seeds * 2, "query_id bigint, chunk_id string, tenant_code string, system_type string"),
                      spark.createDataFrame(chunks + chunks[::4], CH), spark.createDataFrame(mentions, "chunk_id string, entity_name string"),
                      spark.createDataFrame([(a, b, "x") for a, b in relations * 2], "src string, dst string, type string"), 7)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(seeds, chunks, mentions, relations, 7)


def test_lists_are_not_shuffled(spark, monkeypatch):
    """Mentions meet the chunks, then travel once by entity together with the rows that ask; neither scopes nor lists travel."""
    monkeypatch.setattr(G, "FEW_NAMES", -1, raising=False)
    live = spark.range(300).select(F.format_string("c%03d", "id").alias("chunk_id"), (F.col("id") % 3).cast("string").alias("tenant_code"), F.lit("s").alias("system_type"),
                                   F.concat(F.lit("t"), F.col("id") % 100).alias("text_id"))
    mentions = live.select("chunk_id", F.lit("e").alias("entity_name"))
    asked = spark.createDataFrame([("e", "all", 1), ("e", "own|1|s", 2), ("e", "own|1|s", 3), ("e", "global", 4), ("e", "own|7|s", 5)], "e2 string, scope string, query_id int")
    got = G.first_other_texts(asked, live, mentions, 40)
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x and "chunk_id" not in x.split("hashpartitioning")[1]]
    assert len(dealt) == 1 and "scope" not in dealt[0].split("hashpartitioning")[1]
    found = {r["query_id"]: [o["other_id"] for o in r["others"]] for r in got.collect()}
    # texts repeat after a hundred chunks; tenants after three, so that each tenant has every text once, and the first chunk of a text counts for all
    own = {t: [f"c{i:03d}" for i in range(300) if i % 3 == t][:40] for t in (0, 1)}
    assert found == {1: [f"c{i:03d}" for i in range(40)], 2: own[1], 3: own[1], 4: own[0]}


def test_first_steps_are_tried_before_others_are_written(spark, monkeypatch):
    """Steps behind the first ones are neither made nor looked up where these fill the question."""
    chunks = spark.range(40).select(F.format_string("c%02d", "id").alias("chunk_id"), F.concat(F.lit("t"), F.col("id")).alias("content"),
                                    F.lit("d").alias("doc_code"), F.lit("0").alias("tenant_code"), F.lit("s").alias("system_type"), F.lit(True).alias("enabled"))
    mentions = chunks.select("chunk_id", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i")).select("chunk_id", F.format_string("e%02d", "i").alias("entity_name"))
    relations = spark.createDataFrame([(f"e{i:02d}", f"e{j:02d}", "x") for i in range(1, 41) for j in range(1, 41)], "src string, dst string, type string")
    seeds = spark.range(10).select(F.col("id").alias("query_id"), F.lit("c07").alias("chunk_id"), F.lit("1").alias("tenant_code"), F.lit("s").alias("system_type"))
    written, cut = [], G.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", counted)
    got = G.multi_hop(seeds, chunks, mentions, relations, 30)
    assert {(r["entity1"], r["entity2"], n) for r, n in ((x, x["n"]) for x in got.groupBy("entity1", "entity2").agg(F.count("*").alias("n")).collect())} == {("e01", "e01", 300)}
    starts, *later = written
    assert starts == 300 and sum(later) <= 10 * (G.FIRST_STEPS + 1)


def test_view_dealt_out_by_a_column(spark, sf_dir):
    """The rows of the view, ready to be met by that column."""
    plain, dealt = view(spark, sf_dir, "v_mention"), view(spark, sf_dir, "v_mention", by="chunk_id")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    met = dealt.hint("merge").join(view(spark, sf_dir, "v_graph_chunk").select("chunk_id"), "chunk_id")
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 2
    with pytest.raises(ValueError):
        view(spark, sf_dir, "v_entity", by="name")


def test_hub_stays_linear(spark):
    chunks = spark.range(10000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.concat(F.lit("t"), F.col("id")).alias("content"),
                                       F.lit("d").alias("doc_code"), F.lit("0").alias("tenant_code"), F.lit("s").alias("system_type"), F.lit(True).alias("enabled"))
    hub = chunks.select("chunk_id", F.lit("hub").alias("entity_name"))
    rel = spark.createDataFrame([("hub", "hub", "self")], "src string, dst string, type string")
    asked = spark.createDataFrame([("hub", "all"), ("hub", "own|1|s"), ("nobody", "all")], "e2 string, scope string")
    texts = G.first_other_texts(asked, chunks.withColumn("text_id", F.col("content")), hub, 30)
    assert [(r["scope"], r["n"]) for r in texts.select("scope", F.size("others").alias("n")).collect()] == [("all", 30)]
    seeds = chunks.select(F.lit(1).cast("bigint").alias("query_id"), "chunk_id", "tenant_code", "system_type")
    assert G.multi_hop(seeds, chunks, hub, rel, 30).count() == 30


def test_search_reads_only_what_it_reaches(spark, tmp_path):
    """Texts are read by the last join alone where the store has text ids, and edges and mentions meet the frontier first."""
    chunks = spark.range(200).select(F.format_string("c%03d", "id").alias("chunk_id"), F.concat(F.lit("t"), F.col("id")).alias("content"), F.col("id").cast("string").alias("text_id"),
                                     F.lit("0").alias("tenant_code"), F.lit("s").alias("system_type"), F.lit(True).alias("enabled"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    mentions = stored.select("chunk_id", F.concat(F.lit("e"), F.col("text_id").cast("int") % 20).alias("entity_name"))
    rel = spark.createDataFrame([(f"e{i}", f"e{(i * 3 + 1) % 20}", "x") for i in range(20)], "src string, dst string, type string")
    seeds = spark.createDataFrame([(1, "c005", "1", "s")], "query_id bigint, chunk_id string, tenant_code string, system_type string")
    got = G.multi_hop(seeds, stored, mentions, rel, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # of the scans left in the plan (the written frontiers are others) one reads texts
    assert sum("content:string" in x.split("ReadSchema")[-1] for x in plan.splitlines() if "FileScan parquet" in x) == 1
    assert {r.entity1 for r in got.collect()} == {"e5"} and {r.entity2 for r in got.collect()} <= {"e16", "e9"}
    same = G.multi_hop(seeds, stored.drop("text_id"), mentions, rel, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.collect()))
    reach = G.reachable(rel, spark.createDataFrame([("e5",)], "e1 string"), 30)
    assert [tuple(r) for r in reach.collect()] == [("e5", ["e16", "e9"])]


def test_extraction_batches_sizes_and_cap(spark):
    sizes = {"a": 50, "b": 51, "c": 151, "d": 230}
    rows = [(d, f"{d}{i:04d}", i, f"T {i}") for d, n in sizes.items() for i in range(n)] + [("e", "e0", -1, "coarse")]
    ch = spark.createDataFrame(rows, "doc_code string, chunk_id string, chunk_index int, content string")
    for cap, d in ((200, (200, 24)), (None, (230, 28))):
        b = G.extraction_batches(ch, cap)
        n = {r["doc_code"]: (r["n"], r["m"]) for r in b.groupBy("doc_code").agg(F.count("*").alias("n"), F.max("batch_no").alias("m")).collect()}
        assert n == {"a": (50, 16), "b": (51, 10), "c": (151, 18), "d": d}
    _, mentions, _, _ = G.build_graph(ch)
    assert mentions.count() == 0
    _, mentions, _, _ = G.build_graph(ch.withColumn("content", F.lit("Alpha")))
    assert mentions.count() == sum(sizes.values())


def test_build_graph_with_failing_extractor_and_attach(spark, tmp_path):
    ch = spark.createDataFrame([("D", "c0", 0, "Alpha meets Beta"), ("D", "c1", 1, "Beta only"), ("E", "c2", 0, "boom")],
                               "doc_code string, chunk_id string, chunk_index int, content string")

    calls = str(tmp_path / "calls")

    def extractor(text: str) -> str:
        with open(calls, "a") as f:
            f.write("x")
        if "boom" in text:
            raise RuntimeError("no")
        return '{"entities":[{"name":" Alpha "},{"name":"Beta","type":"T"},{"name":" "}],"relations":[{"source":"Alpha","target":"Beta"},{"source":"Alpha","target":"Nobody","type":"x"}]}'

    e, m, r, failed = G.build_graph(ch, extractor)
    assert {tuple(x) for x in e.collect()} == {("Alpha", "unknown"), ("Beta", "T")}
    assert m.count() == 4
    assert [tuple(x) for x in r.collect()] == [("Alpha", "Beta", "related")]
    assert [tuple(x) for x in failed.collect()] == [("E", 0, ["c2"], "RuntimeError: no")]
    with open(calls) as f:
        assert f.read() == "xxx"  # one batch, and one that is tried twice
    _, m2, _, _ = G.build_graph(ch, extractor, attach="chunk")
    assert {tuple(x) for x in m2.collect()} == {("c0", "Alpha"), ("c0", "Beta"), ("c1", "Beta")}


def test_delete_leaves_no_dangling_edges(spark):
    ch = spark.createDataFrame([("c1", "D1"), ("c2", "D2"), ("c3", "D3")], "chunk_id string, doc_code string")
    me = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "b"), ("c3", "c"), ("c2", "d"), ("c1", "d")], "chunk_id string, entity_name string")
    en = spark.createDataFrame([(x, "t") for x in "abcd"], "name string, type string")
    re = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "c", "x"), ("d", "c", "x")], "src string, dst string, type string")
    assert {tuple(r) for r in M.exclusive_entities(me, ch).collect()} == {("a", "D1"), ("c", "D3")}
    codes = spark.createDataFrame([("D1",), ("D2",), ("absent",)], "doc_code string")
    c, m, e, r = M.clean_graph(codes, ch, me, en, re)
    names = {x["name"] for x in e.collect()}
    assert names == {"c"}
    assert {tuple(x) for x in r.collect()} == {("c", "c", "x")}
    assert {x["chunk_id"] for x in m.collect()} == {"c3"} == {x["chunk_id"] for x in c.collect()}


def test_mark_sources_deleted_edges(spark):
    rows = [(1, None), (2, "[]"), (3, '[{"docCode":"A","deleted":true},{"docCode":"B"}]'), (4, '[{"docCode":"C","deleted":false}]'), (5, "not json")]
    out = M.mark_sources_deleted(spark.createDataFrame(rows, "id bigint, sources string"), spark.createDataFrame([("B",)], "doc_code string"))
    got = {r["id"]: r["sources"] for r in out.collect()}
    assert got[1] is None and got[2] == "[]" and got[4] == rows[3][1] and got[5] == "not json"
    assert got[3] == '[{"docCode":"A","deleted":true},{"docCode":"B","deleted":true}]'


def test_visible_relations_cases(spark):
    ch = spark.createDataFrame([("c1", "1", "s"), ("c2", "2", "t"), ("c0", "0", "t")], "chunk_id string, tenant_code string, system_type string")
    me = spark.createDataFrame([("c1", "a"), ("c2", "b"), ("c0", "c")], "chunk_id string, entity_name string")
    re = spark.createDataFrame([("a", "b", "x"), ("b", "b", "x"), ("b", "c", "x"), ("d", "d", "x")], "src string, dst string, type string")
    seen = lambda t, s: sorted((r["src"], r["dst"]) for r in G.visible_relations(re, me, ch, t, s).collect())
    assert seen(None, None) == seen("0", None) == [("a", "b"), ("b", "b"), ("b", "c"), ("d", "d")]
    assert seen("1", None) == [("a", "b"), ("b", "c")]
    assert seen("2", None) == [("a", "b"), ("b", "b"), ("b", "c")]
    assert seen("0", "s") == [("a", "b")]
    assert seen("1", "t") == [("a", "b"), ("b", "c")]
