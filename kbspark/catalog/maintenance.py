"""Document life-cycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.catalog.chunks import chunked_sql
from kbspark.functions.predicates import is_stuck
from kbspark.operators import maintenance as M
from kbspark.plans import ingest
from kbspark.sources.fixtures import view
from kbspark.sources.tables import read_table

META = ["doc_code", "file_name", "title", "description", "status", "error_message", "user_id", "tenant_code", "system_type", "enabled", "upload_time", "file_size"]
SUMMARIES = """best AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN chunk_index >= 0 AND chunk_type <> 'COARSE' THEN 0
    WHEN chunk_index = -1 THEN 1 ELSE 2 END, chunk_index, chunk_id) AS rn, cast(sum(CASE WHEN chunk_index >= 0 AND chunk_type <> 'COARSE' THEN 1 ELSE 0 END)
    OVER (PARTITION BY document_id) AS bigint) AS chunk_count FROM v_chunk_row{visible}),
  summaries AS (SELECT document_id, chunk_count, doc_code, file_name, title, description, status, error_message, user_id, tenant_code, system_type, enabled, upload_time, file_size
    FROM best WHERE rn = 1)"""
ALL, OWN = SUMMARIES.format(visible=""), SUMMARIES.format(visible=" WHERE (tenant_code = '1' AND system_type = 'O') OR tenant_code = '0'")


@register("a10_document_summaries", f"WITH {ALL} SELECT * FROM summaries", "v_chunk_row")
def a10(spark, d):
    return (M.document_summaries(view(spark, d, "v_chunk_row"), META)
            .orderBy(F.col("upload_time").desc_nulls_last(), "document_id"))


@register("a10_visible_documents", f"WITH {OWN} SELECT * FROM summaries", "v_chunk_row")
def a10_visible(spark, d):
    """The document list of one tenant and system: every field, from the chunks it may see."""
    return (M.document_summaries(view(spark, d, "v_chunk_row"), META, "1", "O")
            .orderBy(F.col("upload_time").desc_nulls_last(), "document_id"))


@register("j8_missing_documents", f"""WITH {ALL} SELECT document_id, doc_code, coalesce(tenant_code, 'default') AS tenant_code, coalesce(system_type, 'default') AS system_type,
  file_name, coalesce(title, file_name) AS title, coalesce(file_size, 0) AS file_size, coalesce(status, 'SUCCESS') AS status, chunk_count FROM summaries
  WHERE doc_code NOT IN (SELECT doc_code FROM v_document_info)""", "v_chunk_row v_document_info")
def j8(spark, d):
    return M.missing_documents(M.document_summaries(view(spark, d, "v_chunk_row"), META), view(spark, d, "v_document_info"))


INGESTED = r"""up AS (SELECT doc_code, file_name, file_size, tenant_code, system_type, content, list_filter(list_transform(string_split(content, chr(10)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls, lower(regexp_extract(file_name, '\.([^.]+)$', 1)) AS ext FROM v_document_info),
  norm AS (SELECT doc_code, ext, file_size, CASE WHEN ext = 'md' THEN content ELSE array_to_string(list_transform(ls, lambda x: CASE WHEN ext IN ('doc', 'docx')
    AND length(x) < 100 AND NOT contains(x, '.') AND regexp_matches(x, '[A-Z]') THEN '## ' ELSE '' END || x || chr(10) || chr(10)), '') END AS text FROM up),
  judged AS (SELECT doc_code, text, CASE WHEN file_size = 0 THEN 'file is empty' WHEN file_size > 52428800 THEN 'file exceeds 50 MB' WHEN ext = 'exe' THEN 'file type is not supported'
    WHEN trim(text) = '' THEN 'no text content' END AS reason FROM norm),
  passed AS (SELECT doc_code, text FROM judged WHERE reason IS NULL)"""


@register("g1_ingest_status", f"""WITH RECURSIVE {INGESTED}, {chunked_sql('passed', '。！？；!?;')}, n AS (SELECT doc_code, count(*) AS n FROM chunks WHERE chunk_type = 'FINE' GROUP BY 1)
  SELECT j.doc_code, CASE WHEN reason IS NULL AND n.n > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, reason AS error_message, coalesce(n.n, 0) AS chunk_count,
    reason IS NULL AS enabled FROM judged j LEFT JOIN n ON n.doc_code = j.doc_code""", "v_document_info")
def g1(spark, d):
    uploads = view(spark, d, "v_document_info").select("doc_code", "file_name", "file_size", "tenant_code", "system_type", "content")
    return ingest.ingest_status(uploads, ingest.ingest_chunks(uploads))


@register("g1_ingest_chunks", f"""WITH RECURSIVE {INGESTED}, {chunked_sql('passed', '。！？；!?;')} SELECT c.doc_code, tenant_code, system_type, chunk_id, chunk_type, c.content
  FROM chunks c JOIN v_document_info i ON i.doc_code = c.doc_code""", "v_document_info")
def g1_chunks(spark, d):
    uploads = view(spark, d, "v_document_info").select("doc_code", "file_name", "file_size", "tenant_code", "system_type", "content")
    return ingest.ingest_chunks(uploads).select("doc_code", "tenant_code", "system_type", "chunk_id", "chunk_type", "content")


TRANSITIONS = """tr AS (SELECT 'D' || lpad(cast(doc_id AS string), 8, '0') AS doc_code, CASE WHEN quality = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS new_status,
  doc_id % 9 AS new_chunk_count, CASE WHEN quality = 1 THEN 'reason ' || cast(doc_id AS string) END AS reason FROM labels)"""
AFTER = f"""{TRANSITIONS}, after_docs AS (SELECT i.doc_code, i.tenant_code, coalesce(new_status, status) AS status, CASE WHEN new_status = 'SUCCESS' THEN new_chunk_count ELSE chunk_count END AS chunk_count,
  CASE WHEN new_status = 'SUCCESS' THEN true WHEN new_status = 'FAILED' THEN false ELSE enabled END AS enabled,
  CASE WHEN new_status = 'SUCCESS' THEN NULL WHEN new_status = 'FAILED' THEN reason ELSE 'old error' END AS error_message,
  CASE WHEN new_status IS NOT NULL THEN timestamp '2025-03-04 05:06:07' ELSE created_time END AS updated_time
  FROM v_document_info i LEFT JOIN tr ON tr.doc_code = i.doc_code)"""


def _after(spark, d):
    labels = read_table(spark, d, "labels")
    bad = F.col("quality") == 1
    tr = labels.select(F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("doc_code"),
                       F.when(bad, "FAILED").otherwise("SUCCESS").alias("new_status"), (F.col("doc_id") % 9).alias("new_chunk_count"),
                       F.when(bad, F.concat_ws(" ", F.lit("reason"), F.col("doc_id").cast("string"))).alias("reason"))
    docs = view(spark, d, "v_document_info").select("doc_code", "tenant_code", "status", "chunk_count", "enabled", F.col("created_time").alias("updated_time")).withColumn("error_message", F.lit("old error"))
    return M.apply_transitions(docs, tr, F.lit("2025-03-04 05:06:07").cast("timestamp_ntz"))


@register("g2_status_transitions", f"WITH {AFTER} SELECT * FROM after_docs", "v_document_info")
def g2(spark, d):
    return _after(spark, d)


@register("g2_propagate_status", f"""WITH {AFTER} SELECT chunk_id, c.doc_code, coalesce(a.status, c.status) AS status,
  CASE WHEN a.doc_code IS NULL THEN 'old' ELSE a.error_message END AS error_message FROM v_chunk_vec c LEFT JOIN after_docs a ON a.doc_code = c.doc_code""",
          "v_document_info v_chunk_vec")
def g2_chunks(spark, d):
    return M.propagate_status(view(spark, d, "v_chunk_vec").select("chunk_id", "doc_code", "status", F.lit("old").alias("error_message")), _after(spark, d))


@register("g3_replace_document", """SELECT doc_code, chunk_id, content FROM v_chunk_vec WHERE doc_code NOT IN (SELECT doc_code FROM v_document_info WHERE status = 'FAILED')
  UNION ALL SELECT doc_code, 'new ' || doc_code, title FROM v_document_info WHERE status = 'FAILED'""", "v_chunk_vec v_document_info")
def g3(spark, d):
    failed = view(spark, d, "v_document_info").filter("status = 'FAILED'")
    new = failed.select("doc_code", F.concat_ws(" ", F.lit("new"), "doc_code").alias("chunk_id"), F.col("title").alias("content"))
    return M.replace_rows(view(spark, d, "v_chunk_vec").select("doc_code", "chunk_id", "content"), new)


@register("g4_plan_reprocess", """WITH files AS (SELECT 'uploads/T' || tenant_code || '/' || stored_file_name AS path FROM v_document_info WHERE file_size < 2000)
  SELECT doc_code, tenant_code, 1 AS retry_count, 'uploads/T' || tenant_code || '/' || stored_file_name AS expected_path,
  CASE WHEN 'uploads/T' || tenant_code || '/' || stored_file_name IN (SELECT path FROM files WHERE path IS NOT NULL) THEN 'REPROCESS' ELSE 'FAILED' END AS outcome FROM v_document_info
  WHERE status = 'PROCESSING' AND created_time < timestamp '2024-01-01 10:00:00' AND coalesce(retry_count, 0) = 0""", "v_document_info")
def g4(spark, d):
    docs = view(spark, d, "v_document_info")
    files = docs.filter("file_size < 2000").select(F.concat(F.lit("uploads/T"), "tenant_code", F.lit("/"), "stored_file_name").alias("path"))
    return M.plan_reprocess(docs, is_stuck("2024-01-01 12:00:00"), files)


GONE = """gone AS (SELECT 'D' || cast(c_custkey AS string) AS doc_code FROM customer WHERE c_acctbal < 0),
  dead AS (SELECT entity_name FROM v_mention m JOIN v_graph_chunk c ON c.chunk_id = m.chunk_id GROUP BY entity_name
    HAVING count(*) = count(*) FILTER (doc_code IN (SELECT doc_code FROM gone)))"""
LEFT_OVER = """SELECT 'chunk' AS kind, chunk_id AS a, doc_code AS b FROM v_graph_chunk WHERE doc_code NOT IN (SELECT doc_code FROM gone)
  UNION ALL SELECT 'mention', m.chunk_id, m.entity_name FROM v_mention m JOIN v_graph_chunk c ON c.chunk_id = m.chunk_id WHERE doc_code NOT IN (SELECT doc_code FROM gone)
  UNION ALL SELECT 'entity', name, type FROM v_entity WHERE name NOT IN (SELECT entity_name FROM dead)
  UNION ALL SELECT 'relation', src, dst FROM v_relation WHERE src NOT IN (SELECT entity_name FROM dead) AND dst NOT IN (SELECT entity_name FROM dead)"""
GV = "v_graph_chunk v_mention v_entity v_relation"


def _deleted(spark, d):
    codes = (read_table(spark, d, "customer").filter("c_acctbal < 0")
             .select(F.concat(F.lit("D"), F.col("c_custkey").cast("string")).alias("doc_code")))
    docs = read_table(spark, d, "customer").select(F.concat(F.lit("D"), F.col("c_custkey").cast("string")).alias("doc_code"))
    return M.cascade_delete(codes, docs, *[view(spark, d, v) for v in ("v_graph_chunk", "v_mention", "v_entity", "v_relation")])


def _kinds(chunks, mentions, entities, relations):
    rows = ((chunks, "chunk", "chunk_id", "doc_code"), (mentions, "mention", "chunk_id", "entity_name"),
            (entities, "entity", "name", "type"), (relations, "relation", "src", "dst"))
    parts = [df.select(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")) for df, k, a, b in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("g5_clean_graph", f"WITH {GONE} {LEFT_OVER}", GV)
def g5(spark, d):
    return _kinds(*_deleted(spark, d)[1:])


@register("g6_cascade_delete", f"""WITH {GONE} SELECT kind, count(*) AS n, min(a) AS first_a, max(a) AS last_a FROM ({LEFT_OVER}
  UNION ALL SELECT 'document', 'D' || cast(c_custkey AS string), '' FROM customer WHERE c_acctbal >= 0) t GROUP BY kind""", GV)
def g6(spark, d):
    docs, *graph = _deleted(spark, d)
    rows = _kinds(*graph).unionByName(docs.select(F.lit("document").alias("kind"), F.col("doc_code").alias("a"), F.lit("").alias("b")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first_a"), F.max("a").alias("last_a"))


@register("g7_mark_sources_deleted", """WITH gone AS (SELECT doc_code FROM v_document_info WHERE status = 'FAILED'),
  s AS (SELECT id, sources, json_extract_string(sources, '$[0].docCode') AS a, json_extract_string(sources, '$[1].docCode') AS b FROM v_chat_message),
  f AS (SELECT *, coalesce(a IN (SELECT doc_code FROM gone), false) AS da, coalesce(b IN (SELECT doc_code FROM gone), false) AS db FROM s)
  SELECT id, CASE WHEN da OR db THEN '[{"docCode":"' || a || '","deleted":' || cast(da AS string) || '},{"docCode":"' || b || '","deleted":' || cast(db AS string) || '}]'
    ELSE sources END AS sources FROM f""", "v_chat_message v_document_info")
def g7(spark, d):
    codes = view(spark, d, "v_document_info").filter("status = 'FAILED'")
    return M.mark_sources_deleted(view(spark, d, "v_chat_message"), codes).select("id", "sources")


@register("g7_messages_citing", """SELECT id, session_id FROM v_chat_message WHERE json_extract_string(sources, '$[0].docCode') IN (SELECT doc_code FROM v_document_info WHERE status = 'FAILED')
  OR json_extract_string(sources, '$[1].docCode') IN (SELECT doc_code FROM v_document_info WHERE status = 'FAILED')""", "v_chat_message v_document_info")
def g7_citing(spark, d):
    codes = view(spark, d, "v_document_info").filter("status = 'FAILED'")
    return M.messages_citing(view(spark, d, "v_chat_message"), codes).select("id", "session_id")


@register("g8_backfill_stored_name", r"""SELECT doc_code, CASE WHEN coalesce(stored_file_name, '') = '' AND file_name LIKE '%.%' THEN doc_code || '.' || regexp_extract(file_name, '([^.]*)$', 1)
  ELSE stored_file_name END AS stored_file_name FROM v_document_info""", "v_document_info")
def g8(spark, d):
    return M.backfill_stored_name(M.backfill_stored_name(view(spark, d, "v_document_info"))).select("doc_code", "stored_file_name")


@register("g9_fill_model", """SELECT coalesce(nullif(CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 11 = 0 THEN NULL ELSE model END, ''), 'deepseek-v4.1-flash') AS model, count(*) AS n
  FROM v_api_key_usage GROUP BY 1""", "v_api_key_usage")
def g9(spark, d):
    m = F.when(F.col("l_partkey") % 7 == 0, "").when(F.col("l_partkey") % 11 != 0, F.col("model"))
    u = view(spark, d, "v_api_key_usage").withColumn("model", m)
    return M.fill_model(u, "deepseek-v4.1-flash").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@register("g11_key_changes", """SELECT id, is_delete OR coalesce(c_acctbal < 0, false) AS is_delete, CASE WHEN c_acctbal > 9000 THEN NOT enabled ELSE enabled END AS enabled
  FROM v_api_key k JOIN customer c ON c.c_custkey = k.id""", "v_api_key")
def g11(spark, d):
    c = read_table(spark, d, "customer")
    changes = c.filter("c_acctbal < 0 OR c_acctbal > 9000").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "DELETE").otherwise("TOGGLE").alias("action"))
    return M.apply_key_changes(view(spark, d, "v_api_key"), changes).select("id", "is_delete", "enabled")


@register("g13_remote_files", r"""SELECT url, fn AS file_name, CASE WHEN fn LIKE '%.md' THEN 'MARKDOWN' ELSE 'UNKNOWN' END AS document_type, length(html) AS file_size FROM (
  SELECT url, html, coalesce(nullif(regexp_extract(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), ''), 'downloaded-file') AS fn FROM (
  SELECT *, CASE WHEN page_id % 10 = 1 THEN 'http://host.example.com/' WHEN page_id % 2 = 0 THEN regexp_replace(url, '\?', '.md?') ELSE url END AS u FROM pages) p) q""")
def g13(spark, d):
    k = F.col("page_id")
    u = F.when(k % 10 == 1, "http://host.example.com/").when(k % 2 == 0, F.regexp_replace("url", r"\?", ".md?")).otherwise(F.col("url"))
    rows = read_table(spark, d, "pages").select(F.col("url").alias("page_url"), u.alias("url"), "html")
    return (M.remote_file_rows(rows, content="html", keep=("page_url",))
            .select(F.col("page_url").alias("url"), "file_name", "document_type", "file_size"))


@register("f18_supplementary_files", r"""SELECT i.doc_code, lower(regexp_extract(coalesce(stored_file_name, file_name), '\.([^.]+)$', 1)) = l.ext AS accepted
  FROM v_document_info i JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'docx' ELSE 'md' END AS ext FROM labels) l ON l.doc_id = i.id""", "v_document_info")
def f18_join(spark, d):
    up = read_table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "a.DOCX").otherwise("b.md").alias("uploaded"))
    return view(spark, d, "v_document_info").join(up, "id").select("doc_code", M.format_matches("stored_file_name", "file_name", "uploaded").alias("accepted"))


@register("w7_document_codes", """WITH up AS (SELECT o_orderkey AS id, o_orderdate AS created_time, strftime(o_orderdate, '%Y%m%d') || CASE o_custkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'P' ELSE 'F' END AS prefix FROM orders),
  ex AS (SELECT strftime(l_shipdate, '%Y%m%d') || 'D' AS prefix, max(cast(l_partkey % 1200 AS bigint)) AS m FROM lineitem GROUP BY 1),
  s AS (SELECT up.*, coalesce(m, 0) + row_number() OVER (PARTITION BY up.prefix ORDER BY created_time, id) AS seq FROM up LEFT JOIN ex ON ex.prefix = up.prefix)
  SELECT id, prefix || CASE WHEN seq < 1000 THEN lpad(cast(seq AS string), 3, '0') ELSE cast(seq AS string) END AS new_doc_code FROM s""")
def w7(spark, d):
    k = F.col("o_custkey") % 3
    up = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_time"),
                                               F.when(k == 0, "a.docx").when(k == 1, "b.PDF").otherwise("c").alias("file_name"))
    n = (F.col("l_partkey") % 1200).cast("string")
    old = read_table(spark, d, "lineitem").select(F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lit("D"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("doc_code"))
    return M.assign_doc_codes(up, old, F.col("created_time")).select("id", "new_doc_code")
