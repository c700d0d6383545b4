"""Streams in several batches equal their batch twins; repeated batches change nothing."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from kbspark.operators import ordered, sessions
from kbspark.operators import usage as U
from kbspark.plans.ingest import run_ingest
from kbspark.sources import files, sinks
from kbspark.streaming import batches as B
from kbspark.streaming import stateful as S
from kbspark.streaming import windows as W
from kbspark.streaming.usage_stream import two_sinks

T0 = dt.datetime(2024, 1, 1)


def portions(spark, df, cuts, path, run):
    """Rows in portions, each as files of its own; the query is started anew for each."""
    for p in cuts:
        df.filter(p).write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(df.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint")


def test_quota_stream_over_restarts(spark, tmp_path):
    calls = spark.range(60).select((F.col("id") % 3).alias("api_key_id"), F.lit("s").alias("session_id"), F.col("id").alias("n"),
                                   (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_time"), F.lit(10).cast("bigint").alias("total_cost_e8"))
    keys = spark.createDataFrame([(0, -1), (1, 55)], "id bigint, quota_e8 bigint")  # key 2 has no quota
    order = ["created_time", "n"]
    portions(spark, calls, [F.col("n").between(a, a + 19) for a in (0, 20, 40)], str(tmp_path), lambda s, out, c: B.append_available(S.admit_stream(s, keys, order, ["n"]), out, c))
    want = U.admit_calls(calls, keys, order).select("api_key_id", "n", "used_before_e8", "admitted")
    got = spark.read.parquet(str(tmp_path / "out")).select("api_key_id", "n", "used_before_e8", "admitted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    B.append_available(S.admit_stream(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), keys, order, ["n"]), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert got.count() == 60  # nothing new: nothing is admitted twice


def test_trigger_and_delta_over_restarts(spark, tmp_path):
    m = spark.range(50).select(F.col("id"), F.lit("s").alias("session_id"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("create_time"))
    portions(spark, m, [F.col("id") < 13, F.col("id").between(13, 13), F.col("id") > 13], str(tmp_path / "m"), lambda s, out, c: B.append_available(S.summary_trigger(s), out, c))
    assert sorted((r["id"], r["at_count"]) for r in spark.read.parquet(str(tmp_path / "m" / "out")).collect()) == [(9, 10), (19, 20), (29, 30), (39, 40), (49, 50)]
    f = spark.range(-5, 25).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.repeat(F.lit("ab"), (F.col("id") + 5 - (F.col("id") + 5) % 3).cast("int")).alias("text"))
    portions(spark, f, [F.col("seq") < 5, F.col("seq").between(5, 14), F.col("seq") > 14], str(tmp_path / "f"), lambda s, out, c: B.append_available(S.delta_stream(s), out, c))
    got = spark.read.parquet(str(tmp_path / "f" / "out")).select("session_id", "seq", "delta")
    want = sessions.cumulative_to_delta(f)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.agg(F.min("seq")).first()[0] < 0
    late = spark.createDataFrame([("s", 2, "a" * 99)], f.schema)  # covered by what came before
    portions(spark, late, [F.lit(True)], str(tmp_path / "f"), lambda s, out, c: B.append_available(S.delta_stream(s), out, c))
    assert spark.read.parquet(str(tmp_path / "f" / "out")).count() == want.count()


def test_stuck_by_timer_over_restarts(spark, tmp_path):
    ev = [(0, "a", 0, "PROCESSING"), (1, "b", 5, "PROCESSING"), (2, "b", 30, "SUCCESS"), (3, "c", 10, "PROCESSING"), (4, "c", 200, "FAILED"),
          (5, "a", 20, "PROCESSING"), (6, "a", 400, "PROCESSING"), (7, "d", 390, "PROCESSING"), (8, "close", 1000, "SUCCESS"), (9, "late", 990, "PROCESSING"), (10, "c", 995, "PROCESSING"),
          (11, "end", 2000, "FAILED")]
    df = spark.createDataFrame([(i, d, T0 + dt.timedelta(minutes=m), s) for i, d, m, s in ev], "event_id bigint, doc_code string, ts timestamp, status string")
    cuts = [F.col("event_id") <= 3, F.col("event_id").between(4, 7), F.col("event_id").between(8, 10), F.col("event_id") > 10]
    ms = lambda m: 1704067200000 + m * 60000
    seen = []

    def run(s, out, c):
        B.append_available(S.stuck_alerts(s), out, c)
        seen.append(sorted(map(tuple, spark.read.schema("doc_code string, stuck_since_ms bigint").parquet(out).collect())))

    portions(spark, df, cuts, str(tmp_path), run)
    # d has no event after 390: its timer alone raises it; c is raised once
    assert seen[0] == [] and seen[1] == [("a", ms(0)), ("c", ms(10))] and seen[2] == [("a", ms(0)), ("c", ms(10)), ("d", ms(390))]
    assert seen[3] == [("a", ms(0)), ("c", ms(10)), ("d", ms(390)), ("late", ms(990))]


def test_keys_share_cells_of_state(spark, tmp_path, monkeypatch):
    """Many keys, and rows without one: the state has a row for each cell, not for each key, and each key's result is its own."""
    monkeypatch.setattr(S, "CELLS", 5)
    key = F.when(F.col("id") % 101 != 100, F.col("id") % 101)
    calls = spark.range(600).select(key.alias("api_key_id"), F.col("id").alias("n"), (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_time"),
                                    (F.col("id") % 7).alias("total_cost_e8"))
    keys = spark.range(90).select("id", (F.col("id") % 9 - 1).alias("quota_e8"))
    portions(spark, calls, [F.col("n") < 250, F.col("n") >= 250], str(tmp_path / "q"), lambda s, out, c: B.append_available(S.admit_stream(s, keys, ["created_time"], ["n"]), out, c))
    used, want = {}, []
    for i in range(600):
        k = i % 101 if i % 101 != 100 else None
        quota = k % 9 - 1 if k is not None and k < 90 else -1
        want.append((i, k, used.get(k, 0), quota < 0 or used.get(k, 0) < quota))
        used[k] = used.get(k, 0) + i % 7
    got = spark.read.parquet(str(tmp_path / "q" / "out")).select("n", "api_key_id", "used_before_e8", "admitted")
    assert sorted(map(tuple, got.collect())) == want
    assert spark.read.format("statestore").load(str(tmp_path / "q" / "checkpoint")).count() == 6

    code = F.when(F.col("id") % 50 != 49, F.concat(F.lit("d"), F.col("id") % 50))
    ev = spark.range(150).select(code.alias("doc_code"), F.col("id").alias("event_id"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int") * 3)).alias("ts"),
                                 F.when((F.col("id") < 50) | (F.col("id") % 50 % 2 == 1), "PROCESSING").otherwise("SUCCESS").alias("status"))
    portions(spark, ev, [F.col("event_id") < 60, F.col("event_id") >= 60], str(tmp_path / "e"), lambda s, out, c: B.append_available(S.stuck_alerts(s), out, c))
    # events of a document are 150 minutes apart: the even ones are finished too late, odd ones never before the clock (387 minutes) has passed their limit
    got = spark.read.parquet(str(tmp_path / "e" / "out")).collect()
    assert sorted((r["doc_code"] or "", r["stuck_since_ms"]) for r in got) == sorted(("" if i == 49 else f"d{i}", 1704067200000 + i * 180000) for i in range(50))
    assert spark.read.format("statestore").load(str(tmp_path / "e" / "checkpoint")).count() == 6


def test_two_sinks_apply_a_batch_once(spark, tmp_path):
    rows = [(1, f"s{i % 3}", "u", "glm-5.3-flash", 10 * i, 5, 10 * i + 5, 0, T0 + dt.timedelta(hours=i)) for i in range(12)]
    usage = spark.createDataFrame(rows, "api_key_id bigint, session_id string, user_id string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cache_tokens bigint, created_time timestamp")
    keys, ses = B.Ledger(spark, str(tmp_path / "k")), B.Ledger(spark, str(tmp_path / "s"))
    step = two_sinks(keys, ses)
    for i in range(3):
        step(usage.filter(F.hour("created_time") % 3 == i), i)
    assert not keys.apply(keys.read(), 1)
    ses2 = B.Ledger(spark, str(tmp_path / "s2"))
    two_sinks(keys, ses2)(usage.filter(F.hour("created_time") % 3 == 0), 0)  # a batch of which one sink has failed
    assert ses2.read().count() == 1 and U.sum_sessions(ses.read()).exceptAll(U.session_usage(usage)).count() == 0 and ses.read().count() == 3


def test_records_with_any_text(spark, tmp_path):
    texts = ["plain", "with \u001e and \n12\nx", "", None, "é日本" * 3, "\n"]
    df = spark.createDataFrame([(str(i % 2), t) for i, t in enumerate(texts)], "folder string, text string")
    files.write_text_files(df, str(tmp_path / "r"), "folder", "text", rows_per_file=2)
    assert sorted(map(str, (r["text"] for r in files.read_records(spark, str(tmp_path / "r")).collect()))) == sorted(map(str, texts))
    files.write_documents(df.filter("text IS NOT NULL"), str(tmp_path / "d"), "folder", "text")
    s = files.stream_files(spark, str(tmp_path / "d"), most=2)
    sizes = []
    B.run_available(s, lambda b, i: sizes.append(b.count()), "f", str(tmp_path / "c"))
    assert sum(sizes) == 5 and len(sizes) >= 3 and max(sizes) <= 2


def test_written_records_share_files(spark, tmp_path):
    texts = ["plain", "with \u001e and \n12\nx", "", None, "é日本" * 3, "\n", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts * 20], "text string").repartition(2)
    files.write_records(df, str(tmp_path / "r"), "text", 300)
    files.write_records(df, str(tmp_path / "r"), "text", 300)
    written = list((tmp_path / "r").glob("part-*"))
    assert len(written) < len(texts) * 40 / 4 and max(f.stat().st_size for f in written) <= 400
    assert sorted(map(str, (r["text"] for r in files.read_records(spark, str(tmp_path / "r")).collect()))) == sorted(map(str, texts * 40))
    got, sizes = [], []
    s = files.stream_records(spark, str(tmp_path / "r"), most=5)

    def step(b, i):
        rows = b.collect()
        got.extend(None if r["content"] is None else bytes(r["content"]).decode() for r in rows)
        sizes.append(len({r["path"] for r in rows}))

    B.run_available(s, step, "f", str(tmp_path / "c"))
    assert sorted(map(str, got)) == sorted(map(str, texts * 40)) and max(sizes) <= 5 and len(sizes) == -(-len(written) // 5)


def test_uploads_of_a_portion_share_files(spark, tmp_path, monkeypatch):
    from kbspark.catalog import streams

    rows = [(i, "de", None if i == 4 else "" if i == 5 else f"Text {i}. Second\nline é.\n") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(streams, "scratch_dir", lambda s, name: str(tmp_path / name))
    got = {r["doc_code"]: (r["status"], r["chunk_count"]) for r in streams.x7(spark, str(tmp_path)).collect()}
    assert got == {f"D{i}": ("FAILED", 0) if i in (4, 5) else ("SUCCESS", 1) for i in range(60)}
    assert len(list((tmp_path / "x7" / "in").rglob("part-*"))) == 3  # not one for each document


def test_ordered_cuts_one_instant(spark, monkeypatch):
    """A key whose rows share one instant is cut by the rest of the order, and the ledger equals its definition."""
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    r = random.Random(3)
    log = [(i, 1 if i % 5 else 2, r.choice(["SET", "ADD", "ADD", "ADD"]), r.choice([-1, 0, 5, 7, -3, 100]), T0) for i in range(2000)]
    df = spark.createDataFrame(log, "id bigint, api_key_id bigint, type string, amount_cents bigint, created_time timestamp")
    hot = ordered.hot_keys(df, ["api_key_id"], ["created_time", "id"])
    assert {x["__k_api_key_id"]: len(x["__cuts"]) > 50 for x in hot.collect()} == {1: True, 2: True}
    want, balance = {}, {}
    for i, k, kind, amount, _ in log:
        b = balance.get(k, -1)
        ok = kind == "SET" and amount >= -1 or kind == "ADD" and amount > 0 and b >= 0
        balance[k] = (amount if kind == "SET" else b + amount) if ok else b
        want[i] = (ok, balance[k])
    got = U.quota_ledger(df)
    assert {x["id"]: (x["accepted"], x["balance_cents"]) for x in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 6
    page = U.ledger_page(got, 1, 3)
    ids = [x["id"] for x in page.collect()]
    assert ids == sorted(ids, reverse=True) and len(ids) == 3
    after = U.ledger_page(got, 1, 2, (T0, ids[-1]))
    assert [x["id"] for x in after.collect()][0] < ids[-1]


def test_session_windows(spark, hot_rows):
    rows = [(1, i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate((0, 119, 300, 420, 539, 1400, 1500, 2900))] + [(2, 9, T0)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp")
    a, b = W.activity_sessions(df), W.activity_sessions_batch(df)
    assert sorted(r["uses"] for r in b.collect()) == [1, 1, 2, 2, 3]
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.select(a.columns).exceptAll(a).count() == 0


def test_ingest_run_twice_is_the_same(spark, tmp_path):
    up = spark.createDataFrame([("D1", "a.txt", 10, "1", "s", "line one\n\nline two"), ("D2", "b.exe", 10, "1", "s", "x"), ("D3", "c.md", 10, "0", "s", " \n "),
                                ("D4", "d.txt", 0, "0", "s", ""), ("D5", "e.docx", 9, "0", "s", "Title\nbody.")],
                               "doc_code string, file_name string, file_size bigint, tenant_code string, system_type string, content string")
    for _ in range(2):
        run_ingest(up, str(tmp_path / "c"), str(tmp_path / "s"))
    st = {r["doc_code"]: (r["status"], r["error_message"], r["chunk_count"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert st == {"D1": ("SUCCESS", None, 1), "D2": ("FAILED", "file type is not supported", 0), "D3": ("FAILED", "no text content", 0),
                  "D4": ("FAILED", "file is empty", 0), "D5": ("SUCCESS", None, 1)}
    ch = sinks.read_chunks(spark, str(tmp_path / "c"))
    assert ch.count() == 4
    assert ch.filter("doc_code = 'D5' AND chunk_type = 'FINE'").first()["content"] == "[Title]\n\nbody."


def test_text_file_sources(spark, tmp_path):
    (tmp_path / "t" / "T1").mkdir(parents=True)
    (tmp_path / "t" / "T1" / "D1.txt").write_text("héllo\nzwei", encoding="utf-8")
    (tmp_path / "t" / "T1" / "D2.md").write_text("# x", encoding="utf-8")
    rows = {r["file_name"]: (r["text"], r["file_size"]) for r in files.read_text_files(spark, str(tmp_path / "t")).collect()}
    assert rows == {"D1.txt": ("héllo\nzwei", 11), "D2.md": ("# x", 3)}
    assert {(r["file_name"], r["ext"]) for r in files.read_binary_files(spark, str(tmp_path / "t")).collect()} == {("D1.txt", "txt"), ("D2.md", "md")}
    assert files.list_files(spark, str(tmp_path / "t")).count() == 2


def test_embedder_and_exports(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(1)
        assert len(texts) <= 16
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.range(40).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("content")).coalesce(1)
    assert sinks.embed(df, embedder).filter(F.col("embedding")[0] != F.length("content")).count() == 0
    q = spark.createDataFrame([(1, 'say "hi", ok', "two\nlines")], "id int, question string, answer string")
    sinks.write_csv(q, str(tmp_path / "csv"))
    assert '"say ""hi"", ok"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    m = spark.range(30).select(F.col("id"), F.lit("s").alias("session_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"),
                               F.lit("[]").alias("sources"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("create_time"))
    long = m.withColumn("question", F.format_string("q%02d", "id")).unionByName(m.limit(1).withColumns({"session_id": F.lit("t u"), "sources": F.lit('[{"docCode":"D1"},{"docCode":"D2"}]')}))
    sinks.write_conversations(long, str(tmp_path / "md"), per_part=7, folders=4)
    parts = sorted(sinks.read_conversations(spark, str(tmp_path / "md"), "s").collect(), key=lambda r: r["part"])
    assert [r["part"] for r in parts] == [0, 1, 2, 3, 4] and [r["markdown"].count("**User") for r in parts] == [7, 7, 7, 7, 2]
    assert [line[-3:] for r in parts for line in r["markdown"].splitlines() if line.startswith("**User")] == [f"q{i:02d}" for i in range(30)]
    assert sinks.read_conversations(spark, str(tmp_path / "md"), "t u").first()["markdown"].endswith("\n\n1. D1\n2. D2")
    index = {(r["session_id"], r["part"]): (r["messages"], r["first_id"], r["last_id"]) for r in spark.read.parquet(str(tmp_path / "md" / "index")).collect()}
    assert index["s", 1] == (7, 7, 13) and index["s", 4] == (2, 28, 29) and len(index) == 6 and sinks.read_conversations(spark, str(tmp_path / "md"), "none").count() == 0
