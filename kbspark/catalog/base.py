"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.functions import scalars as C
from kbspark.functions.predicates import range_defaults
from kbspark.operators import maintenance as M
from kbspark.operators import reports
from kbspark.sources import files, schemas, sinks
from kbspark.sources.fixtures import view
from kbspark.sources.store import ChunkStore
from kbspark.sources.tables import query_with, read_table


@register("s1_text_files", """
SELECT tenant_code, content AS text, length(content) AS n FROM v_document_info""", "v_document_info")
def s1(spark, d):
    """Documents written to files of a thousand length-prefixed records each, and read back."""
    path = files.scratch_dir(spark, "s1")
    docs = view(spark, d, "v_document_info").select("tenant_code", "content")
    files.write_text_files(docs, path, "tenant_code", "content", rows_per_file=1000)
    return files.read_records(spark, path).select(
        F.regexp_extract("path", r"tenant_code=(\w+)/", 1).alias("tenant_code"), "text", F.length("text").cast("bigint").alias("n"))


@register("s2_admission", """
SELECT doc_code, CASE WHEN file_size = 0 THEN 'file is empty' WHEN file_size > 2097152 THEN 'file exceeds 2 MB'
  WHEN lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) = 'exe' THEN 'file type is not supported' END AS reason
FROM (SELECT doc_code, file_name, CASE WHEN id % 31 = 0 THEN 0 ELSE file_size * 200 END AS file_size FROM v_document_info) t""", "v_document_info")
def s2(spark, d):
    size = F.when(F.col("id") % 31 == 0, 0).otherwise(F.col("file_size") * 200)
    return view(spark, d, "v_document_info").select("doc_code", M.admission_reason("file_name", size, 2 << 20).alias("reason"))


@register("s3_parameterised_query", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY o_orderpriority""")
def s3(spark, d):
    return query_with(spark, "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderstatus = :status "
                             "AND o_totalprice > :floor GROUP BY o_orderpriority",
                      {"status": "F", "floor": 100000}, orders=read_table(spark, d, "orders"))


@register("s4_chunk_store", """
SELECT chunk_id, doc_code, tenant_code, system_type, content FROM v_chunk_vec""", "v_chunk_vec")
def s4(spark, d):
    path = files.scratch_dir(spark, "s4")
    sinks.write_chunks(view(spark, d, "v_chunk_vec").select("chunk_id", "doc_code", "tenant_code", "system_type", "content"), path)
    return sinks.read_chunks(spark, path).select("chunk_id", "doc_code", "tenant_code", "system_type", "content")


@register("s4_store_upsert", """
SELECT chunk_id, tenant_code, system_type, chunk_type, version, content, len(embedding) AS dim FROM (
  SELECT chunk_id, tenant_code, system_type, 'FINE' AS chunk_type, CASE WHEN vec_id % 10 < 3 THEN 2 ELSE 1 END AS version, CASE WHEN vec_id % 10 < 3 THEN 'new ' ELSE '' END || coalesce(content, '') AS content,
    embedding FROM v_chunk_vec
  UNION ALL SELECT 'p' || chunk_id, tenant_code, system_type, 'COARSE', 2, coalesce(title, ''), NULL FROM v_chunk_vec) t""", "v_chunk_vec")
def s4_upsert(spark, d):
    """A store of all vectors, then new texts of some fine rows and new coarse rows by another version; the same rows once more change nothing."""
    chunks = view(spark, d, "v_chunk_vec").withColumn("content", F.coalesce("content", F.lit("")))
    keep = ["chunk_id", "tenant_code", "system_type", "content", "embedding"]
    fine = chunks.select("vec_id", *keep).withColumns({"chunk_type": F.lit("FINE"), "version": F.lit(1)})
    some = fine.filter("vec_id % 10 < 3").withColumns({"content": F.concat(F.lit("new "), "content"), "version": F.lit(2)})
    coarse = chunks.select(F.concat(F.lit("p"), "chunk_id").alias("chunk_id"), "tenant_code", "system_type", F.coalesce("title", F.lit("")).alias("content"),
                           F.lit(None).cast("array<float>").alias("embedding"), F.lit("COARSE").alias("chunk_type"), F.lit(2).alias("version"))
    store = ChunkStore(spark, files.scratch_dir(spark, "s4-store"))
    store.upsert(fine.drop("vec_id"))
    second = some.drop("vec_id").unionByName(coarse)
    done = store.upsert(second)
    if store.upsert(second) != done:
        raise RuntimeError("the same rows made another version")
    return store.read(done).select("chunk_id", "tenant_code", "system_type", "chunk_type", "version", "content", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dim"))


@register("s5_csv_export", """
SELECT cast(id AS string) AS id, question, answer FROM v_unanswered""", "v_unanswered")
def s5(spark, d):
    path = files.scratch_dir(spark, "s5")
    sinks.write_csv(view(spark, d, "v_unanswered").select(F.col("id").cast("string").alias("id"), "question", "answer"), path)
    return sinks.read_csv(spark, path, "id string, question string, answer string")


@register("s6_markdown_export", """
SELECT session_id, id, '**User:** ' || question || chr(10) || chr(10) || '**Assistant:** ' || answer
  || CASE WHEN sources = '[]' THEN '' ELSE chr(10) || chr(10) || '1. ' || json_extract_string(sources, '$[0].docCode') || chr(10) || '2. '
    || json_extract_string(sources, '$[1].docCode') END AS markdown FROM v_chat_message""", "v_chat_message")
def s6(spark, d):
    return sinks.conversation_markdown(view(spark, d, "v_chat_message")).select("session_id", "id", "markdown")


@register("s6_export_files", """
SELECT session_id, cast((rn - 1) // 40 AS int) AS part, string_agg('**User:** ' || question || chr(10) || chr(10) || '**Assistant:** ' || coalesce(answer, ''),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) AS markdown
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY create_time, id) AS rn FROM v_long_session) t GROUP BY 1, 2""", "v_long_session")
def s6_files(spark, d):
    """Long sessions exported to files in parts of 40 messages, and read back."""
    path = files.scratch_dir(spark, "s6")
    sinks.write_conversations(view(spark, d, "v_long_session").withColumn("sources", F.lit("[]")), path, per_part=40, folders=8)
    return sinks.read_conversations(spark, path)


@register("s7_json_converters", """
SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS json,
  '{}' AS empty FROM events""")
def s7(spark, d):
    parsed = F.from_json("props", "struct<k:bigint>")
    return read_table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(F.to_json(parsed), F.lit("{}")).alias("json"),
                                                 F.coalesce(F.lit(None).cast("string"), F.lit("{}")).alias("empty"))


@register("s8_row_markdown", """
SELECT p_partkey, '| ' || cast(p_partkey AS string) || ' | ' || p_name || ' | ' || p_type || ' | ' || cast(p_size AS string) || ' |' AS line FROM part""")
def s8(spark, d):
    return read_table(spark, d, "part").select("p_partkey", C.row_markdown(["p_partkey", "p_name", "p_type", "p_size"]).alias("line"))


@register("s9_unanswered_export", """
SELECT id, question, answer FROM v_unanswered WHERE create_time >= timestamp '2024-01-08 00:00:00' AND create_time < timestamp '2024-01-15 00:00:00'
UNION ALL SELECT id, question, answer FROM v_unanswered WHERE id IN (5, 11, 15, 29, 35)""", "v_unanswered")
def s9(spark, d):
    q = view(spark, d, "v_unanswered")
    lo, hi = range_defaults(F.lit(None).cast("string"), F.lit("2024-01-15"), F.lit("2024-06-01").cast("timestamp"))
    return reports.export_rows(q, lo, hi).unionByName(reports.export_rows(q, ids=F.lit("5, 11,x,15,,29,35")))


@register("schema_evolution", """
SELECT doc_code, status, chunk_count, enabled, file_size, 0 AS retry_count, error_message FROM (
  SELECT doc_code, status, cast(chunk_count AS int) AS chunk_count, enabled, file_size, CAST(NULL AS string) AS error_message FROM v_document_info WHERE status = 'SUCCESS'
  UNION ALL SELECT doc_code, 'PROCESSING', 0, true, file_size, NULL FROM v_document_info WHERE status <> 'SUCCESS') t""", "v_document_info")
def schema_evolution(spark, d):
    """Rows of today's layout and older rows without the later columns, brought to one schema."""
    docs = view(spark, d, "v_document_info")
    new = docs.filter("status = 'SUCCESS'").drop("retry_count")
    old = docs.filter("status <> 'SUCCESS'").select("doc_code", "file_size")
    both = schemas.conform(new, "document_info").unionByName(schemas.conform(old, "document_info"))
    return both.select("doc_code", "status", "chunk_count", "enabled", "file_size", "retry_count", "error_message")
