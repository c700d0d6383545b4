"""Conversation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.functions.scalars import format_time
from kbspark.operators import reports, sessions
from kbspark.sources.fixtures import view
from kbspark.sources.tables import read_table


@register("w1_latest_per_session", """SELECT session_id, id, question, create_time FROM (SELECT *, row_number() OVER
  (PARTITION BY session_id ORDER BY create_time DESC, id DESC) AS rn FROM v_long_session) t WHERE rn = 1""", "v_long_session")
def w1(spark, d):
    return sessions.latest_messages(view(spark, d, "v_long_session")).select("session_id", "id", "question", "create_time")


@register("w2_recent_page", """SELECT session_id, id, cast(rn AS int) AS rn FROM (SELECT *, row_number() OVER
  (PARTITION BY session_id ORDER BY create_time DESC, id DESC) AS rn FROM v_long_session) t WHERE rn > 5 AND rn <= 15
  UNION ALL SELECT session_id, id, cast(-rn AS int) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY create_time, id) AS rn
  FROM v_long_session) t WHERE rn <= 3""", "v_long_session")
def w2(spark, d):
    m = view(spark, d, "v_long_session")
    old = sessions.oldest_messages(m, 3).select("session_id", "id", (-F.col("rn")).alias("rn"))
    return sessions.recent_messages(m, 10, 5).select("session_id", "id", "rn").unionByName(old)


@register("w4_cumulative_to_delta", """SELECT session_id, seq, substring(text, length(prev) + 1) AS delta FROM (SELECT *, coalesce(lag(text) OVER
  (PARTITION BY session_id ORDER BY seq), '') AS prev FROM v_fragment) t WHERE length(text) > length(prev)""", "v_fragment")
def w4(spark, d):
    return sessions.cumulative_to_delta(view(spark, d, "v_fragment"))


@register("w8_title_inheritance", """SELECT id, session_id, coalesce(last_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY create_time, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS inherited_title FROM v_chat_message""", "v_chat_message")
def w8(spark, d):
    return sessions.inherit_titles(view(spark, d, "v_chat_message")).select("id", "session_id", "inherited_title")


@register("w10_history_context", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY create_time DESC, id DESC) AS rn,
    count(*) OVER (PARTITION BY session_id) AS n FROM v_long_session),
  t AS (SELECT session_id, any_value(n) AS n, string_agg('User: ' || question || chr(10) || 'Assistant: ' || coalesce(answer, ''), chr(10) || chr(10)
    ORDER BY create_time, id) AS recent FROM r WHERE rn <= 10 GROUP BY session_id)
  SELECT t.session_id, n AS total_count, greatest(n - 10, 0) AS older_count, n > 10 AND (trim(coalesce(summary, '')) = '' OR n - coalesce(last_message_count, 0) >= 10) AS needs_summary,
  CASE WHEN n > 10 AND trim(coalesce(summary, '')) <> '' THEN '[Earlier summary]' || chr(10) || summary || chr(10) || chr(10) || '[Recent exchanges]' || chr(10) || recent
  ELSE recent END AS context FROM t LEFT JOIN v_session_summary s ON s.session_id = t.session_id""", "v_long_session v_session_summary")
def w10(spark, d):
    return sessions.history_context(view(spark, d, "v_long_session"), view(spark, d, "v_session_summary"))


@register("w10_older_messages", """SELECT session_id, id, question FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY create_time DESC, id DESC) AS rn
  FROM v_long_session) t WHERE rn > 10""", "v_long_session")
def w10_older(spark, d):
    return sessions.older_messages(view(spark, d, "v_long_session")).select("session_id", "id", "question")


@register("a7_unanswered_stats", """SELECT question, count(*) AS cnt, max(create_time) AS last_time FROM v_unanswered
  WHERE create_time >= timestamp '2024-01-03 00:00:00' AND create_time < timestamp '2024-01-28 00:00:00' GROUP BY question""", "v_unanswered")
def a7(spark, d):
    return reports.by_count(reports.unanswered_stats(view(spark, d, "v_unanswered"), "2024-01-03", "2024-01-28"))


@register("a8_stats_envelope", """SELECT count(DISTINCT question) AS question_count, count(*) AS total FROM v_unanswered WHERE tenant_code = '3'""", "v_unanswered")
def a8(spark, d):
    return reports.stats_envelope(reports.unanswered_stats(view(spark, d, "v_unanswered"), tenant="3"))


@register("a9_document_stats", """SELECT tenant_code, count(*) AS doc_count, cast(sum(chunk_count) AS bigint) AS chunk_total FROM v_document_info
  WHERE status = 'SUCCESS' GROUP BY ROLLUP (tenant_code)
  UNION ALL SELECT 'only 2', count(*), cast(coalesce(sum(chunk_count), 0) AS bigint) FROM v_document_info WHERE status = 'SUCCESS' AND tenant_code = '2'""", "v_document_info")
def a9(spark, d):
    docs = view(spark, d, "v_document_info")
    one = reports.document_stats(docs, "2").select(F.lit("only 2").alias("tenant_code"), "doc_count", "chunk_total")
    return reports.document_stats_by_tenant(docs).unionByName(one)


@register("a11_messages_per_session", "SELECT session_id, count(*) AS message_count FROM v_chat_message GROUP BY session_id", "v_chat_message")
def a11(spark, d):
    return sessions.messages_per_session(view(spark, d, "v_chat_message"))


@register("a14_daily_digest", """WITH w AS (SELECT * FROM v_unanswered WHERE create_time >= timestamp '2024-01-14 00:00:00' AND create_time < timestamp '2024-01-15 00:00:00')
  SELECT question, count(*) AS cnt, max(create_time) AS last_time, (SELECT count(DISTINCT question) FROM w) AS question_count, (SELECT count(*) FROM w) AS total
  FROM w GROUP BY question ORDER BY cnt DESC, last_time DESC, question LIMIT 20""", "v_unanswered")
def a14(spark, d):
    return reports.digest(view(spark, d, "v_unanswered"), F.lit("2024-01-15").cast("timestamp"))


@register("x8_daily_counts", """SELECT strftime(date_trunc('day', create_time), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS cnt FROM v_unanswered GROUP BY 1
  UNION ALL SELECT strftime(create_time, '%Y-%m'), count(*) FROM v_unanswered GROUP BY 1""", "v_unanswered")
def x8(spark, d):
    daily = reports.daily_counts(view(spark, d, "v_unanswered"))
    monthly = reports.monthly_counts(daily).select(F.col("month").alias("day"), "cnt")
    return daily.select(format_time("day").alias("day"), "cnt").unionByName(monthly)


UPSERT = """SELECT session_id, arg_min(user_id, (create_time, id)) AS user_id, (list(api_key_id ORDER BY create_time, id))[1] AS api_key_id,
  arg_min(tenant_code, (create_time, id)) AS tenant_code, arg_min(system_type, (create_time, id)) AS system_type,
  arg_max(title, (create_time, id)) AS title, min(create_time) AS create_time, max(create_time) AS update_time FROM v_chat_message GROUP BY session_id"""


@register("g10_save_conversation", UPSERT, "v_chat_message")
def g10(spark, d):
    m = view(spark, d, "v_chat_message")
    old = F.col("create_time") < F.lit("2024-01-03").cast("timestamp")
    return sessions.save_conversation(m.filter(old), m.filter(~old))[1]


@register("j7_missing_sessions", """SELECT session_id, title, create_time FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY create_time DESC, id DESC) AS rn
  FROM v_chat_message) t WHERE rn = 1 AND session_id NOT IN (SELECT session_id FROM v_chat_message WHERE title <> '')""", "v_chat_message")
def j7(spark, d):
    m = view(spark, d, "v_chat_message")
    have = m.filter("title <> ''").select("session_id").distinct()
    return sessions.missing_sessions(m, have).select("session_id", "title", "create_time")


@register("j14_delete_sessions", """WITH gone AS (SELECT session_id FROM v_chat_message WHERE api_key_id = 10 OR user_id = 'u5')
  SELECT 'message' AS kind, session_id, count(*) AS n FROM v_chat_message WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY session_id
  UNION ALL SELECT 'summary', session_id, 1 FROM (SELECT DISTINCT session_id FROM v_chat_message WHERE title <> '') s WHERE session_id NOT IN (SELECT session_id FROM gone)
  UNION ALL SELECT 'session', session_id, 1 FROM (SELECT DISTINCT session_id FROM v_chat_message) s WHERE session_id NOT IN (SELECT session_id FROM gone)""", "v_chat_message")
def j14(spark, d):
    m = view(spark, d, "v_chat_message")
    tables = (m, m.filter("title <> ''").select("session_id").distinct(), m.select("session_id").distinct())
    of_user = m.filter("user_id = 'u5'").select("session_id").distinct()
    of_key = m.select("session_id").distinct().withColumn("api_key_id", F.lit(10).cast("bigint"))
    left = sessions.delete_sessions(of_key, *sessions.delete_sessions(of_user, *tables), owned=True)
    parts = [t.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "session_id", "n")
             for k, t in zip(("message", "summary", "session"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("j15_update_titles", """WITH new AS (SELECT cast(conv_id AS string) AS session_id, max('new title ' || cast(conv_id AS string)) AS title FROM conversations WHERE role = 'system' GROUP BY 1)
  SELECT 'message' AS kind, cast(m.id AS string) AS k, coalesce(n.title, m.title) AS title FROM v_chat_message m LEFT JOIN new n ON n.session_id = m.session_id
  UNION ALL SELECT 'session', s.session_id, coalesce(n.title, s.title) FROM (SELECT session_id, max(title) AS title FROM v_chat_message GROUP BY session_id) s
  LEFT JOIN new n ON n.session_id = s.session_id
  UNION ALL SELECT 'usage', u.session_id, coalesce(n.title, u.title) FROM (SELECT session_id, min(question) AS title FROM v_chat_message GROUP BY session_id) u
  LEFT JOIN new n ON n.session_id = u.session_id""", "v_chat_message")
def j15(spark, d):
    m = view(spark, d, "v_chat_message")
    sid = F.col("conv_id").cast("string")
    new = (read_table(spark, d, "conversations").filter("role = 'system'")
           .groupBy(sid.alias("session_id")).agg(F.max(F.concat(F.lit("new title "), sid)).alias("title")))
    msg, ses, use = sessions.update_titles(new, m, m.groupBy("session_id").agg(F.max("title").alias("title")), m.groupBy("session_id").agg(F.min("question").alias("title")))
    return (msg.select(F.lit("message").alias("kind"), F.col("id").cast("string").alias("k"), "title")
            .unionByName(ses.select(F.lit("session").alias("kind"), F.col("session_id").alias("k"), "title"))
            .unionByName(use.select(F.lit("usage").alias("kind"), F.col("session_id").alias("k"), "title")))
