"""Filters, scalars, paging and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.functions import predicates as P
from kbspark.functions import scalars as C
from kbspark.functions.text import NEGATIVE_MARKERS
from kbspark.operators import maintenance as M
from kbspark.operators import paging as T
from kbspark.operators import reports, retrieval, sessions
from kbspark.operators.layout import spread
from kbspark.sources.files import scratch_dir
from kbspark.sources.fixtures import view
from kbspark.sources.tables import read_table


@register("f1_retrieval_visibility", """
SELECT chunk_id, tenant_code, doc_code FROM v_chunk_vec
WHERE enabled AND status = 'SUCCESS' AND (tenant_code = '1' OR tenant_code = '0') AND system_type = 's1'""", "v_chunk_vec")
def f1(spark, d):
    return view(spark, d, "v_chunk_vec").filter(P.visible_for_retrieval("1", "s1")).select("chunk_id", "tenant_code", "doc_code")


@register("f2_graph_visibility", """
SELECT chunk_id, tenant_code, system_type FROM v_graph_chunk
WHERE enabled AND ((tenant_code = '2' AND system_type = 'F') OR tenant_code = '0')""", "v_graph_chunk")
def f2(spark, d):
    return view(spark, d, "v_graph_chunk").filter(P.visible_in_graph("2", "F")).select("chunk_id", "tenant_code", "system_type")


@register("f3_bind_filter", """
SELECT id, name FROM v_api_key WHERE lower(name) LIKE '%00_' AND system_type IN ('BUILDING', 'MACHINERY') AND enabled = true""", "v_api_key")
def f3(spark, d):
    cond = P.bind_filter({"name": "%00_", "systemType": ["BUILDING", "MACHINERY"], "enabled": True, "creator": "x",
                          "tenantCode": ""})
    return view(spark, d, "v_api_key").filter(cond).select("id", "name")


@register("f4_criteria_filter", """
SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'small%' AND p_size IN (1, 5, 11, 20) AND p_brand ILIKE 'brand#2%'""")
def f4(spark, d):
    cond = P.criteria_filter({"pName": "SMALL", "pSize": [1, 5, 11, 20], "pBrand": "brand#2", "extend": "ignored"})
    return read_table(spark, d, "part").filter(cond).select("p_partkey", "p_name")


@register("f5_document_list", """
SELECT doc_code, status, file_name FROM v_document_info
WHERE tenant_code = '1' AND status = 'SUCCESS' AND (contains(lower(file_name), 'md') OR contains(lower(title), 'md'))""", "v_document_info")
def f5(spark, d):
    return (view(spark, d, "v_document_info").filter(P.document_list_filter("1", status="success", keyword="MD"))
            .select("doc_code", "status", "file_name"))


@register("f6_session_filter", """
SELECT id, session_id FROM v_chat_message WHERE user_id = 'u3' AND tenant_code = '3'""", "v_chat_message")
def f6(spark, d):
    return view(spark, d, "v_chat_message").filter(P.session_filter("u3", "3")).select("id", "session_id")


@register("f7_usage_of_key", """
SELECT session_id, model, total_tokens FROM v_api_key_usage WHERE api_key_id = 7""", "v_api_key_usage")
def f7(spark, d):
    return (view(spark, d, "v_api_key_usage").filter(P.bind_filter({"apiKeyId": 7}))
            .select("session_id", "model", "total_tokens"))


@register("f8_tenant_keyword", """
SELECT tenant_code, tenant_name FROM v_tenant WHERE contains(lower(tenant_name), 'nation_1')""", "v_tenant")
def f8(spark, d):
    return view(spark, d, "v_tenant").filter(P.contains_ci("tenant_name", "Nation_1")).select("tenant_code", "tenant_name")


@register("f9_time_range", """
SELECT id, question FROM v_unanswered WHERE create_time >= timestamp '2024-01-05 00:00:00'
AND create_time < timestamp '2024-01-20 12:00:00' AND tenant_code = '2'""", "v_unanswered")
def f9(spark, d):
    return (view(spark, d, "v_unanswered").filter(P.in_time_range("2024-01-05", "2024-01-20 12:00:00", "2"))
            .select("id", "question"))


@register("f10_range_defaults", """
WITH r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '2024-02-01' WHEN 1 THEN '2024-02-01 10:00:00' WHEN 2 THEN 'bad' WHEN 3 THEN '2024-13-01' ELSE NULL END AS s,
  CASE c_custkey % 3 WHEN 0 THEN ' 2024-03-05 ' WHEN 1 THEN '' ELSE NULL END AS e FROM customer),
p AS (SELECT c_custkey, coalesce(try_strptime(nullif(trim(e), ''), '%Y-%m-%d'), timestamp '2024-06-01 00:00:00') AS en,
  coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%d')) AS st FROM r)
SELECT c_custkey, strftime(coalesce(st, en - interval '7' day), '%Y-%m-%d %H:%M:%S') AS range_start, strftime(en, '%Y-%m-%d %H:%M:%S') AS range_end FROM p""")
def f10(spark, d):
    k = F.col("c_custkey")
    s = (F.when(k % 5 == 0, "2024-02-01").when(k % 5 == 1, "2024-02-01 10:00:00").when(k % 5 == 2, "bad")
         .when(k % 5 == 3, "2024-13-01"))
    e = F.when(k % 3 == 0, " 2024-03-05 ").when(k % 3 == 1, "")
    lo, hi = P.range_defaults(s, e, F.lit("2024-06-01").cast("timestamp"))
    return read_table(spark, d, "customer").select("c_custkey", C.format_time(lo).alias("range_start"),
                                                   C.format_time(hi).alias("range_end"))


@register("f11_id_list", """
SELECT id, question FROM v_unanswered WHERE id IN (SELECT try_cast(trim(x) AS bigint)
  FROM (SELECT unnest(string_split('3, 12,abc,,29, 4x,35,61,88,118', ',')) AS x))""", "v_unanswered")
def f11(spark, d):
    ids = P.parse_id_list(F.lit("3, 12,abc,,29, 4x,35,61,88,118"))
    return view(spark, d, "v_unanswered").filter(F.array_contains(ids, F.col("id"))).select("id", "question")


@register("f12_stuck_documents", """
SELECT doc_code, created_time FROM v_document_info WHERE status = 'PROCESSING'
AND created_time < timestamp '2024-01-01 10:00:00' - interval '2' hour AND coalesce(retry_count, 0) = 0""", "v_document_info")
def f12(spark, d):
    return view(spark, d, "v_document_info").filter(P.is_stuck("2024-01-01 10:00:00")).select("doc_code", "created_time")


@register("f13_source_projection", """
SELECT chunk_id, coalesce(file_name, 'unknown file') AS file_name, coalesce(title, 'untitled document') AS title, doc_code, tenant_code,
  chunk_index, coalesce(page_number, '1') AS page_number, title_hierarchy, content, false AS deleted FROM v_chunk_vec""", "v_chunk_vec")
def f13(spark, d):
    return view(spark, d, "v_chunk_vec").select("chunk_id", retrieval.source_struct().alias("s")).select("chunk_id", "s.*")


@register("f14_effective_key", """
SELECT s_suppkey, id, tenant_code FROM (SELECT s_suppkey, k.id, k.tenant_code, row_number() OVER (PARTITION BY s_suppkey ORDER BY k.id) AS rn
  FROM supplier JOIN v_api_key k ON sha256('sk-' || cast(k.id AS string)) = sha256('sk-' || cast(s_suppkey AS string))
  WHERE k.enabled AND NOT k.is_delete) t WHERE rn = 1""", "v_api_key")
def f14(spark, d):
    keys = (view(spark, d, "v_api_key").withColumn("key_hash", C.key_hash(F.concat(F.lit("sk-"), F.col("id").cast("string"))))
            .filter(F.col("enabled") & ~F.col("is_delete"))
            .groupBy("key_hash").agg(F.min("id").alias("id"), F.min_by("tenant_code", "id").alias("tenant_code")))
    asked = read_table(spark, d, "supplier").select("s_suppkey", C.key_hash(
        F.concat(F.lit("sk-"), F.col("s_suppkey").cast("string"))).alias("key_hash"))
    return asked.join(keys, "key_hash").select("s_suppkey", "id", "tenant_code")


@register("f15_has_quota", """
SELECT k.id, CASE WHEN k.quota_e8 < 0 THEN true ELSE coalesce(u.used, 0) < k.quota_e8 END AS has_quota
FROM v_api_key k LEFT JOIN (SELECT api_key_id, sum(total_tokens) * 100 AS used FROM v_api_key_usage GROUP BY 1) u ON u.api_key_id = k.id""",
          "v_api_key v_api_key_usage")
def f15(spark, d):
    used = view(spark, d, "v_api_key_usage").groupBy("api_key_id").agg((F.sum("total_tokens") * 100).alias("used_e8"))
    keys = view(spark, d, "v_api_key")
    return keys.join(used, keys.id == used.api_key_id, "left").select("id", P.has_quota().alias("has_quota"))


@register("f16_negative_answer", """
SELECT id FROM v_chat_message WHERE contains(answer, 'nicht') OR contains(answer, 'que la') OR contains(answer, 'the the')""", "v_chat_message")
def f16(spark, d):
    return view(spark, d, "v_chat_message").filter(P.contains_any("answer", ["nicht", "que la", "the the"])).select("id")


@register("f17_unanswered_decision", """
SELECT id, (api_key_id IS NOT NULL AND api_key_id % 7 = 1) OR (sources <> '[]' AND (contains(answer, 'die') OR contains(answer, 'que') OR contains(answer, 'not found')))
  AS unanswered FROM v_chat_message""", "v_chat_message")
def f17(spark, d):
    n = F.size(F.from_json("sources", M.SOURCES_SCHEMA))
    flag = F.coalesce(F.col("api_key_id") % 7 == 1, F.lit(False))
    return view(spark, d, "v_chat_message").select(
        "id", P.is_unanswered(flag, n, "answer", ["die", "que", *NEGATIVE_MARKERS[1:2]]).alias("unanswered"))


@register("f18_format_match", """
SELECT doc_code, lower(regexp_extract(coalesce(stored_file_name, file_name), '\\.([^.]+)$', 1)) = CASE WHEN id % 2 = 0 THEN 'docx' ELSE 'md' END AS matches
FROM v_document_info""", "v_document_info")
def f18(spark, d):
    up = F.when(F.col("id") % 2 == 0, "new.DOCX").otherwise("new.md")
    return view(spark, d, "v_document_info").select("doc_code", M.format_matches("stored_file_name", "file_name", up).alias("matches"))


@register("f19_billable_usage", """
SELECT api_key_id, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE api_key_id END AS api_key_id,
  CASE WHEN l_suppkey % 17 = 0 THEN 0 WHEN l_suppkey % 19 = 0 THEN NULL ELSE total_tokens END AS total_tokens FROM v_api_key_usage) t
WHERE api_key_id IS NOT NULL AND total_tokens > 0 GROUP BY api_key_id""", "v_api_key_usage")
def f19(spark, d):
    u = view(spark, d, "v_api_key_usage").select(
        F.when(F.col("l_partkey") % 50 != 0, F.col("api_key_id")).alias("api_key_id"),
        F.when(F.col("l_suppkey") % 17 == 0, 0).when(F.col("l_suppkey") % 19 != 0, F.col("total_tokens")).alias("total_tokens"))
    return u.filter(P.billable()).groupBy("api_key_id").agg(F.count(F.lit(1)).alias("n"))


@register("f20_tenant_write_rules", """
SELECT request_id, tenant_code, CASE WHEN tenant_code = '' THEN 'tenant code is required' WHEN tenant_name = '' THEN 'tenant name is required'
  WHEN tenant_code = '0' THEN 'tenant 0 is reserved'
  WHEN tenant_code IN (SELECT tenant_code FROM v_tenant) OR request_id > min(CASE WHEN tenant_name <> '' THEN request_id END) OVER (PARTITION BY tenant_code)
  THEN 'tenant code exists' END AS reason FROM v_tenant_request""", "v_tenant v_tenant_request")
def f20(spark, d):
    return M.tenant_write_reason(view(spark, d, "v_tenant_request"), view(spark, d, "v_tenant")).select("request_id", "tenant_code", "reason")


@register("f21_user_conversations", """
SELECT id, session_id, question FROM v_chat_message WHERE user_id = 'u4' AND tenant_code = '4' AND system_type = 's0'""", "v_chat_message")
def f21(spark, d):
    return sessions.user_conversations(view(spark, d, "v_chat_message"), "u4", "4", "s0").select("id", "session_id", "question")


@register("f22_session_messages_of_key", """
SELECT id, question, (SELECT count(*) FROM v_chat_message WHERE session_id = '10' AND api_key_id = 10) AS owned
FROM v_chat_message WHERE session_id = '10' AND api_key_id = 10""", "v_chat_message")
def f22(spark, d):
    m = sessions.session_messages_of_key(view(spark, d, "v_chat_message"), "10", 10)
    return m.withColumn("owned", m.agg(F.count(F.lit(1)).alias("n")).scalar()).select("id", "question", "owned")


# --- scalar functions ---------------------------------------------------------------------------

@register("c1_c2_c3_file_names", """
SELECT page_id, regexp_extract(n, '\\.([^.]+)$', 1) AS ext, CASE lower(regexp_extract(n, '\\.([^.]+)$', 1)) WHEN 'txt' THEN 'TEXT' WHEN 'csv' THEN 'TEXT'
  WHEN 'md' THEN 'MARKDOWN' WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'WORD' WHEN 'xls' THEN 'EXCEL' WHEN 'pptx' THEN 'POWERPOINT' ELSE 'UNKNOWN' END AS file_type,
  coalesce(nullif(upper(substring(regexp_extract(n, '\\.([^.]+)$', 1), 1, 1)), ''), 'F') AS letter
FROM (SELECT page_id, 'p' || cast(page_id AS string) || CASE page_id % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.csv' WHEN 3 THEN '.a.pdf'
  WHEN 4 THEN '.docx' WHEN 5 THEN '.xls' WHEN 6 THEN '.pptx' WHEN 7 THEN '.' ELSE '' END AS n FROM pages) t""")
def c1(spark, d):
    ends = [".txt", ".MD", ".csv", ".a.pdf", ".docx", ".xls", ".pptx", ".", ""]
    end = F.lit("")
    for i, e in enumerate(ends):
        end = F.when(F.col("page_id") % 9 == i, e).otherwise(end)
    n = F.concat(F.lit("p"), F.col("page_id").cast("string"), end)
    return read_table(spark, d, "pages").select("page_id", C.file_extension(n).alias("ext"), C.file_type(n).alias("file_type"),
                                                C.type_letter(n).alias("letter"))


@register("c4_c5_key_hash_mask", """
SELECT id, sha256('sk-' || name) AS key_hash, substring('sk-' || name, 1, 11) || '...' AS key_prefix FROM v_api_key""", "v_api_key")
def c4(spark, d):
    raw = F.concat(F.lit("sk-"), F.col("name"))
    return view(spark, d, "v_api_key").select("id", C.key_hash(raw).alias("key_hash"), C.key_prefix(raw).alias("key_prefix"))


@register("c6_ellipsis", """
SELECT doc_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS short,
  CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END AS preview FROM documents""")
def c6(spark, d):
    return read_table(spark, d, "documents").select("doc_id", C.ellipsis("text").alias("short"), C.ellipsis("text", 60).alias("preview"))


@register("c7_clean_title", """
SELECT conv_id, turn, substring(regexp_replace(regexp_replace(regexp_replace('  "' || text, '^\\s+|\\s+$', '', 'g'), '["''`]', '', 'g'), '\\s+', ' ', 'g'), 1, 30) AS title
FROM conversations""")
def c7(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", C.clean_title(F.concat(F.lit('  "'), F.col("text"))).alias("title"))


@register("c8_question_title", """
SELECT id, coalesce(nullif(substring(CASE WHEN id % 7 = 0 THEN '' ELSE question END, 1, 50), ''), session_id) AS title FROM v_chat_message""", "v_chat_message")
def c8(spark, d):
    q = F.when(F.col("id") % 7 == 0, "").otherwise(F.col("question"))
    return view(spark, d, "v_chat_message").select("id", C.question_title(q, "session_id").alias("title"))


@register("c9_null_to_zero", """
SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def c9(spark, d):
    return (read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id", "left")
            .select("doc_id", C.null_to_zero("toxic").alias("toxic")))


@register("c10_time_format_parse", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""")
def c10(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    bad = F.when(F.col("o_orderkey") % 4 == 0, F.concat(iso, F.lit("x"))).otherwise(iso)
    return read_table(spark, d, "orders").select("o_orderkey", C.format_time("o_orderdate").alias("shown"),
                                                 C.format_time(C.parse_iso_time(bad)).alias("parsed"))


@register("c11_month_bounds", """
SELECT o_orderkey, cast(date_trunc('month', o_orderdate) AS date) AS month_start, cast(date_trunc('month', o_orderdate) + interval '1' month AS date) AS month_end,
  strftime(o_orderdate, '%Y-%m') AS month_label FROM orders""")
def c11(spark, d):
    a, b, label = C.month_bounds("o_orderdate")
    return read_table(spark, d, "orders").select("o_orderkey", a.alias("month_start"), b.alias("month_end"), label.alias("month_label"))


@register("c12_title_prefix", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN '[' || p_brand || ' > ' || p_type || ']' || chr(10) || chr(10)
  ELSE '[' || p_brand || ' > ' || p_name || ' > ' || p_type || ']' || chr(10) || chr(10) END AS prefix FROM part""")
def c12(spark, d):
    k = F.col("p_partkey") % 5
    h = (F.when(k == 0, F.array(F.lit(""), F.lit("  "))).when(k == 1, F.array(F.col("p_brand"), F.lit(" "), F.col("p_type")))
         .otherwise(F.array("p_brand", "p_name", "p_type")))
    return read_table(spark, d, "part").select("p_partkey", C.title_prefix(h).alias("prefix"))


@register("c13_numeric_id", """
WITH h AS (SELECT doc_id, md5(text) AS m FROM documents),
  w AS (SELECT doc_id, xor(xor(cast('0x' || m[1:8] AS bigint), cast('0x' || m[9:16] AS bigint)), xor(cast('0x' || m[17:24] AS bigint), cast('0x' || m[25:32] AS bigint))) AS x FROM h)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE abs(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) END AS numeric_id FROM w""")
def c13(spark, d):
    m = F.md5("text")
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    bad = F.when(F.col("doc_id") % 9 == 0, F.concat(uuid, F.lit("x"))).otherwise(uuid)
    return read_table(spark, d, "documents").select("doc_id", C.numeric_id(bad).alias("numeric_id"))


@register("c14_snake_case_columns", """
SELECT p_partkey, p_retailprice, p_type FROM part""")
def c14(spark, d):
    return read_table(spark, d, "part").select(*[P.snake_case(c) for c in ("pPartkey", "pRetailprice", "pType")])


@register("c15_sources_json", """
SELECT id, coalesce(nullif(replace(sources, ' ', ''), ''), '{}') AS sources_json FROM v_chat_message""", "v_chat_message")
def c15(spark, d):
    parsed = F.from_json("sources", "array<struct<docCode:string,deleted:boolean>>")
    return view(spark, d, "v_chat_message").select("id", F.coalesce(F.to_json(parsed), F.lit("{}")).alias("sources_json"))


@register("c16_base_name", """
SELECT page_id, list_extract(string_split(url, '/'), -1) AS base_name FROM pages""")
def c16(spark, d):
    return read_table(spark, d, "pages").select("page_id", C.base_name("url").alias("base_name"))


@register("c17_comma_list", """
SELECT conv_id, turn, list_extract(l, 1) AS first_item, len(l) AS n, array_to_string(l, '|') AS items
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM conversations) t""")
def c17(spark, d):
    return (read_table(spark, d, "conversations").select("conv_id", "turn", C.comma_list("text").alias("l"))
            .select("conv_id", "turn", F.get("l", F.lit(0)).alias("first_item"), F.size("l").cast("bigint").alias("n"),
                    F.array_join("l", "|").alias("items")))


@register("c18_token_count", """
SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}]')) AS tokens FROM documents""")
def c18(spark, d):
    return spread(read_table(spark, d, "documents")).select("doc_id", C.token_count("text").cast("bigint").alias("tokens"))


# --- sorts and pages ----------------------------------------------------------------------------

@register("t1_page_with_total", """
SELECT doc_code, created_time, (SELECT count(*) FROM v_document_info WHERE status = 'SUCCESS') AS total_elements,
  cast(ceil((SELECT count(*) FROM v_document_info WHERE status = 'SUCCESS') / 15) AS bigint) AS total_pages
FROM v_document_info WHERE status = 'SUCCESS' ORDER BY created_time DESC, doc_code LIMIT 15 OFFSET 30""", "v_document_info")
def t1(spark, d):
    docs = view(spark, d, "v_document_info").filter(P.document_list_filter(status="SUCCESS")).select("doc_code", "created_time")
    return T.page_with_total(docs, [F.col("created_time").desc(), F.col("doc_code").asc()], 2, 15)


DEEP = "ORDER BY l_extendedprice DESC NULLS LAST, l_shipdate, l_orderkey, l_linenumber LIMIT 50 OFFSET (SELECT count(*) * 7 // 10 // 50 * 50 FROM lineitem)"


@register("t1_deep_page", f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem {DEEP}")
def t1_deep(spark, d):
    """A page at seven tenths of all rows, by a jump into the page index."""
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    keys = [T.Key("l_extendedprice", False), T.Key("l_shipdate"), T.Key("l_orderkey"), T.Key("l_linenumber")]
    index = T.PageIndex.build(rows, keys, scratch_dir(spark, "pages"), rows_per_range=10_000)
    total = sum(n for _, n in index.counts())
    return index.jump(total * 7 // 10 // 50, 50).select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("t2_sort_builder", """
SELECT event_id, user_id, event_type FROM events ORDER BY lower(event_type), cast(json_extract_string(props, '$.k') AS varchar) DESC NULLS LAST, user_id, event_id LIMIT 40""")
def t2(spark, d):
    keys = T.sort_columns([T.Order("eventType", ignore_case=True), T.Order("data.k", ascending=False), T.Order("userId"),
                           T.Order("eventId")])
    return T.page(read_table(spark, d, "events").withColumnRenamed("props", "data"), keys, 0, 40).select("event_id", "user_id", "event_type")


@register("t3_total_cost_sort", """
SELECT o_orderkey, output_cost_e8 + input_cost_e8 AS cost FROM (SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS input_cost_e8, o_custkey AS output_cost_e8 FROM orders) t
ORDER BY cost DESC, o_orderkey LIMIT 25""")
def t3(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("input_cost_e8"), F.col("o_custkey").alias("output_cost_e8"))
    return (T.page(o, [*T.sort_columns([T.Order("totalCost", ascending=False)]), F.col("o_orderkey").asc()], 0, 25)
            .select("o_orderkey", (F.col("output_cost_e8") + F.col("input_cost_e8")).alias("cost")))


@register("t4_top_scored", """
SELECT chunk_id, rerank_score FROM v_rerank_score ORDER BY rerank_score DESC NULLS LAST, chunk_id LIMIT 30""", "v_rerank_score v_chunk_vec")
def t4(spark, d):
    return T.top_scored(view(spark, d, "v_rerank_score"), 30, "rerank_score").select("chunk_id", "rerank_score")


@register("t5_own_tenant_first", """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN qt = '0' THEN 0 WHEN ct = qt THEN 0 ELSE 1 END, rn) AS position
FROM (SELECT s.query_id, c.chunk_id, cast(s.query_id % 5 AS string) AS qt, c.tenant_code AS ct,
  row_number() OVER (PARTITION BY s.query_id ORDER BY s.rerank_score DESC NULLS LAST, c.chunk_id) AS rn
  FROM v_rerank_score s JOIN v_chunk_vec c ON c.chunk_id = s.chunk_id) t WHERE rn <= 20""", "v_rerank_score v_chunk_vec")
def t5(spark, d):
    s = view(spark, d, "v_rerank_score").join(view(spark, d, "v_chunk_vec").select("chunk_id", "tenant_code"), "chunk_id")
    by_score = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "chunk_id")
    top = s.withColumn("rn", F.row_number().over(by_score)).filter("rn <= 20")
    own = T.own_tenant_first((F.col("query_id") % 5).cast("string"), F.col("tenant_code"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(own, "rn"))
    return top.select("query_id", "chunk_id", pos.cast("bigint").alias("position"))


@register("t6_page_count", """
SELECT doc_id, cast(ceil(n_chars / 1000) AS bigint) AS pages, cast(0 AS bigint) AS none FROM documents""")
def t6(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.page_count(F.col("n_chars"), 1000).alias("pages"),
                                                    T.page_count(F.col("n_chars"), 0).alias("none"))


@register("t7_message_page", """
SELECT id, question FROM v_long_session WHERE session_id = 's8' ORDER BY create_time DESC, id DESC LIMIT 10 OFFSET 20""", "v_long_session")
def t7(spark, d):
    m = view(spark, d, "v_long_session").filter(F.col("session_id") == "s8")
    return T.page(m, [F.col("create_time").desc(), F.col("id").desc()], 2, 10).select("id", "question")


@register("t7_next_messages", """
SELECT id, session_id FROM v_long_session ORDER BY answer DESC NULLS LAST, create_time, id LIMIT 30 OFFSET 60""", "v_long_session")
def t7_next(spark, d):
    """The third page by the last row of the second, which came by the last row of the first; null answers stand last."""
    m = view(spark, d, "v_long_session").select("id", "session_id", "answer", "create_time")
    keys, last = [T.Key("answer", False), T.Key("create_time"), T.Key("id")], None
    for _ in range(2):
        rows = T.next_page(m, keys, last, 30).select(*[k.column for k in keys]).collect()  # a page
        last = tuple(rows[-1]) if rows else last
    return T.next_page(m, keys, last, 30).select("id", "session_id")


# --- set operations ------------------------------------------------------------------------------

@register("u3_tenant_list", """
SELECT cast(NULL AS bigint) AS id, '0' AS tenant_code, 'All tenants' AS tenant_name, true AS enabled
UNION ALL SELECT id, tenant_code, tenant_name, enabled FROM v_tenant WHERE enabled""", "v_tenant")
def u3(spark, d):
    return reports.tenant_list(view(spark, d, "v_tenant"))


@register("u4_distinct_tuple", """
SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem""")
def u4(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").distinct()


@register("u5_edge_merge", """
SELECT src, dst, max(type) AS type FROM (SELECT src, dst, type FROM v_relation
  UNION ALL SELECT dst AS src, src AS dst, 'back' AS type FROM v_relation) t GROUP BY src, dst""", "v_relation")
def u5(spark, d):
    from kbspark.operators.graph import merge_edges

    old = view(spark, d, "v_relation").withColumn("at", F.col("type"))
    new = old.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("back").alias("type"), F.lit("back").alias("at"))
    return merge_edges(old.unionByName(new), "at").select("src", "dst", "type")


@register("u6_distinct_parents", """
SELECT DISTINCT p.chunk_id, p.content FROM v_coarse_chunk p
WHERE p.chunk_id IN (SELECT parent_chunk_id FROM v_chunk_vec WHERE trim(coalesce(parent_chunk_id, '')) <> '')""", "v_coarse_chunk v_chunk_vec")
def u6(spark, d):
    return view(spark, d, "v_coarse_chunk").join(retrieval.parent_ids(view(spark, d, "v_chunk_vec")), "chunk_id", "left_semi")
