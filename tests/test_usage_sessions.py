"""Usage, quota, session, paging and predicate edge frames."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.functions import predicates as P
from kbspark.functions import scalars as C
from kbspark.operators import ordered, paging, reports, sessions
from kbspark.operators import usage as U
from kbspark.sources.tables import count_with

T0 = dt.datetime(2024, 1, 1)
USE = "api_key_id bigint, session_id string, user_id string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cache_tokens bigint, created_time timestamp"


def test_cost_edges(spark):
    rows = [(1, "s", "u", "GLM-5.3-flash", 100, 10, 110, 400, T0), (1, "s", "u", None, 5, 5, 10, None, T0), (1, "s", "u", "nope", 5, 5, 10, 1, T0),
            (1, "s", "u", "x", 0, 0, 0, 0, T0), (None, "s", "u", "glm-5.3-flash", 9, 9, 18, 0, T0)]
    df = spark.createDataFrame(rows, USE)
    first = U.with_cost(df).first()
    assert (first["input_cost_e8"], first["output_cost_e8"], first["cache_cost_e8"]) == (0, 2800, 9200)
    s = U.usage_increments(df).collect()
    assert len(s) == 1 and s[0]["total_calls"] == 3 and s[0]["cache_tokens"] == 401


def test_accumulate_equals_rebuild_for_any_split(spark):
    r = random.Random(5)
    rows = [(r.randrange(6), f"s{r.randrange(9)}", "u", r.choice(["glm-5.3-flash", "deepseek-v4.1-flash", "zz"]), r.randrange(100), r.randrange(50),
             r.randrange(1, 150), r.randrange(120), T0 + dt.timedelta(hours=i)) for i in range(300)]
    df = spark.createDataFrame(rows, USE)
    whole = U.usage_increments(df)
    cut = F.pmod(F.xxhash64("created_time"), F.lit(3))
    folded = U.usage_increments(df.filter(cut == 0))
    for i in (1, 2):
        folded = U.accumulate_summary(folded, U.usage_increments(df.filter(cut == i)))
    assert folded.exceptAll(whole.select(folded.columns)).count() == 0 and folded.count() == whole.count()
    keys = spark.createDataFrame([(i,) for i in range(9)], "id bigint")
    assert U.global_totals(whole.filter("1=0"), keys).first()["total_calls"] == 0
    assert U.key_summary(keys.withColumnRenamed("id", "api_key_id"), whole).count() == 9


def test_quota_admission_edges(spark, hot_rows):
    calls = spark.createDataFrame([(k, "s", T0 + dt.timedelta(days=i // 2, minutes=i), i, 10) for k in (1, 2, 3, 4) for i in range(6)],
                                  "api_key_id bigint, session_id string, created_time timestamp, n int, total_cost_e8 bigint")
    keys = spark.createDataFrame([(1, -1), (2, 0), (3, 20), (4, 25)], "id bigint, quota_e8 bigint")
    got = U.admit_calls(calls, keys, ["created_time", "n"]).groupBy("api_key_id").agg(F.count_if("admitted").alias("n"))
    assert {r[0]: r[1] for r in got.collect()} == {1: 6, 2: 0, 3: 2, 4: 3}


def test_ledger_edges(spark, hot_rows):
    log = [(1, 7, "ADD", 100), (2, 7, "SET", 50), (3, 7, "ADD", 25), (4, 7, "ADD", -5), (5, 7, "SET", -1), (6, 7, "ADD", 10), (7, 7, "SET", -3), (8, 7, "SET", 0), (9, 7, "ADD", 1)]
    df = spark.createDataFrame([(*r, T0 + dt.timedelta(days=20 * i)) for i, r in enumerate(log)], "id bigint, api_key_id bigint, type string, amount_cents bigint, created_time timestamp")
    got = [(r["accepted"], r["balance_cents"]) for r in U.quota_ledger(df).orderBy("id").collect()]
    assert got == [(False, -1), (True, 50), (True, 75), (False, 75), (True, -1), (False, -1), (False, -1), (True, 0), (True, 1)]


def test_ordered_helpers_equal_plain_windows(spark, hot_rows):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "b", None, "c" if i < 4 else "a"]), i, r.choice([None, "x", "y", "z"]), r.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v string, n int")
    w = Window.partitionBy("k").orderBy("i")
    plain = df.select("k", "i", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                      F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"), F.lag("i").over(w).alias("p"), F.lead("i").over(w).alias("q"))
    hot = ordered.hot_keys(df, ["k"], ["i"])
    out = ordered.running_sum(df, ["k"], [F.col("i")], {"s": F.col("n")}, hot=hot)
    out = ordered.carry_last(out, ["k"], ["i"], F.col("v"), "c", inclusive=False)
    out = ordered.neighbours(out, ["k"], ["i"], "i", "p", "q", hot=hot).select("k", "i", "s", "c", "p", "q")
    assert out.exceptAll(plain).count() == 0 and out.count() == 200


def messages(spark, sizes):
    rows = [(n * 1000 + i, f"s{n}", f"q{i}", None if i % 4 == 0 else "a", "", T0 + dt.timedelta(minutes=i // 2)) for n in sizes for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, session_id string, question string, answer string, title string, create_time timestamp")


def test_history_edges(spark):
    m = messages(spark, (1, 10, 11, 20))
    s = spark.createDataFrame([("s11", "sum", 1), ("s20", "sum", 11), ("s10", "sum", 0)], "session_id string, summary string, last_message_count int")
    got = {r["session_id"]: r for r in sessions.history_context(m, s).collect()}
    assert [got[k]["needs_summary"] for k in ("s1", "s10", "s11", "s20")] == [False, False, True, False]
    assert got["s10"]["context"].startswith("User: q0") and got["s20"]["context"].startswith("[Earlier summary]\nsum")
    assert got["s11"]["older_count"] == 1
    assert {r["session_id"]: r["n"] for r in sessions.older_messages(m).groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {"s11": 1, "s20": 10}
    assert sessions.latest_messages(m).filter("session_id = 's20'").first()["id"] == 20019


def test_delete_owned_sessions_only(spark):
    m = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 6)], "id bigint, session_id string, api_key_id bigint")
    t = spark.createDataFrame([("a", 5), ("b", 5), ("none", 5)], "session_id string, api_key_id bigint")
    left = sessions.delete_sessions(t, m, m.select("session_id").distinct(), m.select("session_id").distinct(), owned=True)
    assert [sorted(r["session_id"] for r in x.collect()) for x in left] == [["b"]] * 3


def test_paging_edges(spark):
    df = spark.createDataFrame([(1, "b", '{"a":{"x":"2"}}'), (2, "A", '{"a":{"x":"1"}}'), (3, None, None)], "id int, name string, extend string")
    assert paging.page(df, [F.col("id")], 5, 2).count() == 0
    ids = lambda *o: [r["id"] for r in df.orderBy(*paging.sort_columns(o)).collect()]
    assert ids(paging.Order("name", ignore_case=True)) == [3, 2, 1]
    assert ids(paging.Order("name")) == [3, 2, 1]
    assert ids(paging.Order("extend.a.x", ascending=False)) == [1, 2, 3]
    assert df.select(paging.page_count(F.lit(7), 0), paging.page_count(F.lit(7), 3), paging.page_count(F.lit(0), 3)).first()[:] == (0, 3, 0)
    assert [r["id"] for r in paging.next_page(df, [paging.Key("id")], (1,), 5).collect()] == [2, 3]


def test_filter_edges(spark):
    df = spark.createDataFrame([("Abc", 1, True), ("abX", 2, False), ("100%", 3, None)], "doc_name string, n int, enabled boolean")
    n = lambda c: sorted(r["n"] for r in df.filter(c).collect())
    assert n(P.bind_filter({})) == [1, 2, 3]
    assert n(P.bind_filter({"docName": "ABC"})) == [1] and n(P.bind_filter({"docName": "ab%"})) == [1, 2]
    assert n(P.criteria_filter({"docName": "AB"})) == [1, 2] and n(P.criteria_filter({"n": [2, 3], "enabled": False})) == [2]
    assert n(P.bind_filter({"n": 1, "createdTime": "x"}, skip=["n"])) == [1, 2, 3]
    assert n(P.contains_ci("doc_name", "%")) == [3]


def test_scalar_edges(spark):
    df = spark.createDataFrame([("a.b.TXT",), ("noext",), ("dot.",), ("",), (None,), (".md",)], "n string")
    assert [tuple(r) for r in df.select(C.file_extension("n"), C.file_type("n"), C.type_letter("n")).collect()] == [
        ("TXT", "TEXT", "T"), ("", "UNKNOWN", "F"), ("", "UNKNOWN", "F"), ("", "UNKNOWN", "F"), ("", "UNKNOWN", "F"), ("md", "MARKDOWN", "M")]
    u = spark.createDataFrame([("http://h/a/b.pdf?x=1",), ("http://h",), ("http://h/",), ("::bad::",), (None,)], "u string")
    assert [r[0] for r in u.select(C.file_name_from_url("u")).collect()] == ["b.pdf"] + ["downloaded-file"] * 4
    t = spark.createDataFrame([("[[PAGE:2]] x [[PAGE:10]]",), ("[[PAGE:07]]",), ("none",), (None,)], "t string")
    assert [r[0] for r in t.select(C.page_range("t")).collect()] == ["2-10", "7", "1", "1"]


def test_reports_and_counts(spark):
    q = spark.createDataFrame([(1, "a", "1", T0, "x"), (2, "a", "1", T0 + dt.timedelta(days=1), "x")], "id bigint, question string, tenant_code string, create_time timestamp, answer string")
    assert reports.unanswered_stats(q, "2024-01-01", "2024-01-02").first()["cnt"] == 1
    assert reports.stats_envelope(reports.unanswered_stats(q.limit(0))).first()[:] == (0, 0)
    assert count_with(spark, "SELECT count(*) FROM {q} WHERE id > :n", {"n": 1}, q=q) == 1
    assert reports.export_rows(q, ids=F.lit("2,zz,")).count() == 1


def test_numeric_id_of_uuid(spark):
    df = spark.createDataFrame([("00000000-0000-0001-0000-000200000003",), ("80000000-0000-0000-0000-000000000000",), ("not-a-uuid",), (None,),
                                ("ffffffff-0000-0000-0000-000000000000",)], "u string")
    # 1 ^ 2 ^ 3, the one value without a positive twin, two invalid texts, and minus one
    assert [r[0] for r in df.select(C.numeric_id("u")).collect()] == [0, -2147483648, None, None, 1]
