"""Usage, cost and quota queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.operators import paging as T
from kbspark.operators import usage as U
from kbspark.sources.fixtures import view
from kbspark.streaming.usage_stream import fold_batches

USAGE = "v_api_key v_api_key_usage v_model_price"

PRICED = """priced AS (SELECT u.*, greatest(u.prompt_tokens - u.cache_tokens, 0) * coalesce(p.in_e8, 0) AS input_cost_e8,
  u.completion_tokens * coalesce(p.out_e8, 0) AS output_cost_e8, u.cache_tokens * coalesce(p.cache_e8, 0) AS cache_cost_e8
  FROM v_api_key_usage u LEFT JOIN v_model_price p ON p.model = lower(u.model))"""
SUMMARY = PRICED + """, summary AS (SELECT api_key_id, count(*) AS total_calls, cast(sum(prompt_tokens) AS bigint) AS prompt_tokens,
  cast(sum(completion_tokens) AS bigint) AS completion_tokens, cast(sum(total_tokens) AS bigint) AS total_tokens,
  cast(sum(cache_tokens) AS bigint) AS cache_tokens, cast(sum(input_cost_e8) AS bigint) AS input_cost_e8,
  cast(sum(output_cost_e8) AS bigint) AS output_cost_e8, cast(sum(cache_cost_e8) AS bigint) AS cache_cost_e8,
  max(created_time) AS last_used_at FROM priced WHERE total_tokens > 0 AND api_key_id IN (SELECT id FROM v_api_key) GROUP BY api_key_id)"""
SESSION = PRICED + """, session_usage AS (SELECT session_id, min(user_id) AS user_id, count(*) AS chat_count, cast(sum(prompt_tokens) AS bigint) AS input_tokens,
  cast(sum(completion_tokens) AS bigint) AS output_tokens, cast(sum(cache_tokens) AS bigint) AS cache_tokens,
  cast(sum(prompt_tokens + completion_tokens) AS bigint) AS total_tokens, cast(sum(input_cost_e8) AS bigint) AS input_cost_e8,
  cast(sum(output_cost_e8) AS bigint) AS output_cost_e8, cast(sum(cache_cost_e8) AS bigint) AS cache_cost_e8,
  cast(sum(input_cost_e8 + output_cost_e8 + cache_cost_e8) AS bigint) AS total_cost_e8,
  min(created_time) AS created_time, max(created_time) AS updated_time FROM priced GROUP BY session_id)"""


def _usage(spark, d):
    return view(spark, d, "v_api_key_usage")


def _keys(spark, d):
    return view(spark, d, "v_api_key")


def _summary(spark, d):
    return U.rebuild_summary(_usage(spark, d), _keys(spark, d))


@register("a1_rebuild_key_usage", f"WITH {SUMMARY} SELECT * FROM summary", USAGE)
def a1(spark, d):
    return _summary(spark, d)


@register("a2_accumulate_key_usage", f"WITH {SUMMARY} SELECT * FROM summary", USAGE)
def a2(spark, d):
    """Earlier rows as the stored summary, later rows as the increments."""
    u = _usage(spark, d)
    cut = F.col("created_time") < F.lit("1998-01-01").cast("timestamp_ntz")
    return U.accumulate_summary(U.usage_increments(u.filter(cut)), U.usage_increments(u.filter(~cut)))


@register("a3_session_usage", f"WITH {SESSION} SELECT * FROM session_usage", USAGE)
def a3(spark, d):
    u = _usage(spark, d)
    cut = F.col("created_time") < F.lit("1998-01-01").cast("timestamp_ntz")
    return U.accumulate_sessions(U.session_usage(u.filter(cut)), U.session_usage(u.filter(~cut)))


TOTALS = ", ".join(f"cast(coalesce(sum({c}), 0) AS bigint) AS {c}" for c in ("total_calls", *U.TOKEN_COLUMNS, *U.COST_COLUMNS))


@register("a4_global_totals", f"WITH {SUMMARY} SELECT {TOTALS} FROM summary WHERE api_key_id IN (SELECT id FROM v_api_key WHERE NOT is_delete)", USAGE)
def a4(spark, d):
    return U.global_totals(_summary(spark, d), _keys(spark, d).filter("NOT is_delete"))


@register("a5_chat_usage_totals", f"""WITH {SESSION} SELECT count(*) AS total_calls, cast(sum(input_tokens) AS bigint) AS input_tokens,
  cast(sum(output_tokens) AS bigint) AS output_tokens, cast(sum(total_tokens) AS bigint) AS total_tokens, cast(sum(cache_tokens) AS bigint) AS cache_tokens,
  cast(sum(input_cost_e8) AS bigint) AS input_cost_e8, cast(sum(output_cost_e8) AS bigint) AS output_cost_e8,
  cast(sum(cache_cost_e8) AS bigint) AS cache_cost_e8, cast(sum(total_cost_e8) AS bigint) AS total_cost_e8 FROM session_usage""", USAGE)
def a5(spark, d):
    return U.chat_usage_totals(U.session_usage(_usage(spark, d)))


@register("a6_key_counts", """SELECT count(*) FILTER (NOT is_delete) AS active_keys, count(*) FILTER (is_delete) AS deleted_keys FROM v_api_key""", "v_api_key")
def a6(spark, d):
    return U.key_counts(_keys(spark, d))


@register("a16_key_summary", f"""WITH {SUMMARY} SELECT k.id AS api_key_id, coalesce(total_calls, 0) AS total_calls, coalesce(prompt_tokens, 0) AS prompt_tokens,
  coalesce(completion_tokens, 0) AS completion_tokens, coalesce(total_tokens, 0) AS total_tokens, coalesce(cache_tokens, 0) AS cache_tokens
  FROM v_api_key k LEFT JOIN summary s ON s.api_key_id = k.id""", USAGE)
def a16(spark, d):
    return U.key_summary(_keys(spark, d).select(F.col("id").alias("api_key_id")), _summary(spark, d))


@register("a17_existence", """SELECT doc_code, EXISTS (SELECT 1 FROM v_chat_message) AS any_session,
  (SELECT count(*) FROM v_document_info) AS total FROM v_document_info WHERE doc_code = 'D00000012'""", "v_document_info v_chat_message")
def a17(spark, d):
    docs, chats = view(spark, d, "v_document_info"), view(spark, d, "v_chat_message")
    some = chats.select("id").limit(1).agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
    return docs.filter(F.col("doc_code") == "D00000012").select(
        "doc_code", some.alias("any_session"), docs.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total"))


@register("a18_call_cost", f"""WITH {PRICED} SELECT session_id, model, input_cost_e8, output_cost_e8, cache_cost_e8,
  cast(input_cost_e8 + output_cost_e8 + cache_cost_e8 AS double) / 100000000 AS total_cost FROM priced""", USAGE)
def a18(spark, d):
    return U.with_cost(_usage(spark, d)).select("session_id", "model", "input_cost_e8", "output_cost_e8", "cache_cost_e8",
                                                U.e8_to_decimal("total_cost_e8").cast("double").alias("total_cost"))


@register("j1_usage_overview", f"""WITH {SUMMARY} SELECT k.id, k.name, k.is_delete, coalesce(total_calls, 0) AS total_calls, coalesce(total_tokens, 0) AS total_tokens,
  coalesce(input_cost_e8, 0) AS input_cost_e8, coalesce(output_cost_e8, 0) AS output_cost_e8, coalesce(cache_cost_e8, 0) AS cache_cost_e8, last_used_at
  FROM v_api_key k LEFT JOIN summary s ON s.api_key_id = k.id""", USAGE)
def j1(spark, d):
    o = U.usage_overview(_keys(spark, d), _summary(spark, d)).orderBy(*U.overview_order())
    return o.select("id", "name", "is_delete", "total_calls", "total_tokens", *U.COST_COLUMNS, "last_used_at")


@register("j1_overview_page", f"""WITH {SUMMARY} SELECT k.id, coalesce(total_tokens, 0) AS total_tokens, (SELECT count(*) FROM v_api_key) AS total_elements,
  cast(ceil((SELECT count(*) FROM v_api_key) / 10) AS bigint) AS total_pages
  FROM v_api_key k LEFT JOIN summary s ON s.api_key_id = k.id ORDER BY coalesce(total_tokens, 0) DESC, k.id LIMIT 10 OFFSET 10""", USAGE)
def j1_page(spark, d):
    o = U.usage_overview(_keys(spark, d), _summary(spark, d)).select("id", "total_tokens")
    total = _keys(spark, d).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (T.page(o, U.overview_order(), 1, 10).withColumn("total_elements", total)
            .withColumn("total_pages", T.page_count(F.col("total_elements"), 10)))


@register("j6_existing_keys_only", f"WITH {SUMMARY} SELECT api_key_id, total_tokens FROM summary WHERE api_key_id IN (SELECT id FROM v_api_key WHERE enabled)", USAGE)
def j6(spark, d):
    return U.existing_key_summary(_summary(spark, d), _keys(spark, d).filter("enabled")).select("api_key_id", "total_tokens")


@register("j9_sync_used_quota", f"""WITH {SUMMARY} SELECT k.id, k.quota_e8, coalesce((SELECT s.input_cost_e8 + s.output_cost_e8 + s.cache_cost_e8 FROM summary s
  WHERE s.api_key_id = k.id), 0) AS used_e8 FROM v_api_key k""", USAGE)
def j9(spark, d):
    return U.used_quota(_keys(spark, d), _summary(spark, d)).select("id", "quota_e8", "used_e8")


@register("j10_backfill_cache_cost", f"""WITH {SESSION} SELECT session_id, CASE WHEN cache_tokens > 0 THEN cache_tokens * CASE
  WHEN session_id IN (SELECT session_id FROM v_api_key_usage WHERE lower(model) = 'deepseek-v4.1-flash') THEN 20
  WHEN session_id IN (SELECT session_id FROM v_api_key_usage WHERE lower(model) = 'deepseek-v4-flash-0731') THEN 30
  WHEN session_id IN (SELECT session_id FROM v_api_key_usage WHERE lower(model) = 'glm-5.3-flash') THEN 23
  WHEN session_id IN (SELECT session_id FROM v_api_key_usage WHERE lower(model) LIKE 'ernie%') THEN 20 ELSE 0 END ELSE 0 END AS cache_cost_e8
  FROM session_usage""", USAGE)
def j10(spark, d):
    s = U.session_usage(_usage(spark, d)).withColumn("cache_cost_e8", F.lit(0).cast("bigint"))
    return U.backfill_cache_cost(s, _usage(spark, d)).select("session_id", "cache_cost_e8")


CALL_ORDER = ["created_time", "session_id", "l_linenumber", "l_partkey", "l_suppkey", "total_cost_e8"]


@register("w5_quota_admission", f"""WITH {PRICED}, costed AS (SELECT *, input_cost_e8 + output_cost_e8 + cache_cost_e8 AS total_cost_e8 FROM priced),
  run AS (SELECT *, cast(coalesce(sum(total_cost_e8) OVER (PARTITION BY api_key_id ORDER BY {", ".join(CALL_ORDER)}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS used_before_e8 FROM costed)
  SELECT r.api_key_id, r.session_id, r.total_cost_e8, r.used_before_e8, CASE WHEN k.quota_e8 < 0 THEN true ELSE r.used_before_e8 < k.quota_e8 END AS admitted
  FROM run r JOIN v_api_key k ON k.id = r.api_key_id""", USAGE)
def w5(spark, d):
    calls = U.with_cost(_usage(spark, d))
    return (U.admit_calls(calls, _keys(spark, d), CALL_ORDER)
            .select("api_key_id", "session_id", "total_cost_e8", "used_before_e8", "admitted"))


@register("w6_quota_ledger", """WITH e AS (SELECT *, sum(CASE WHEN type = 'SET' THEN 1 ELSE 0 END) OVER (PARTITION BY api_key_id ORDER BY created_time, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM v_quota_log),
  b AS (SELECT *, max(CASE WHEN type = 'SET' THEN amount_cents END) OVER (PARTITION BY api_key_id, epoch) AS base FROM e),
  a AS (SELECT *, type = 'SET' OR (amount_cents > 0 AND coalesce(base, -1) >= 0) AS accepted FROM b)
  SELECT id, api_key_id, type, amount_cents, accepted, cast(coalesce(base, -1) + sum(CASE WHEN accepted AND type = 'ADD' THEN amount_cents ELSE 0 END)
    OVER (PARTITION BY api_key_id, epoch ORDER BY created_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS balance_cents FROM a""", "v_quota_log")
def w6(spark, d):
    return U.quota_ledger(view(spark, d, "v_quota_log")).select("id", "api_key_id", "type", "amount_cents", "accepted", "balance_cents")


@register("w6_quota_history", """SELECT id, type, amount_cents, created_time FROM v_quota_log WHERE api_key_id = (SELECT min(o_custkey) FROM orders)
  ORDER BY created_time DESC, id DESC LIMIT 20""", "v_quota_log")
def w6_history(spark, d):
    """Quota changes of one key, newest first, a page."""
    log = view(spark, d, "v_quota_log")
    key = log.agg(F.min("api_key_id")).first()[0]
    return U.ledger_page(log, key, 20).select("id", "type", "amount_cents", "created_time")


@register("g12_ensure_summary", f"WITH {SUMMARY} SELECT api_key_id, total_calls, total_tokens FROM summary", USAGE)
def g12(spark, d):
    empty = _summary(spark, d).limit(0)
    return U.ensure_summary(empty, _usage(spark, d), _keys(spark, d)).select("api_key_id", "total_calls", "total_tokens")


@register("x1_usage_stream_batches", f"WITH {SUMMARY} SELECT * FROM summary", USAGE)
def x1(spark, d):
    """Usage arriving in four micro-batches, folded by the same upsert the stream uses."""
    u = _usage(spark, d)
    part = F.year("created_time") % 4
    return fold_batches([u.filter(part == i) for i in range(4)])
