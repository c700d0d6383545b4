"""Knowledge-base tables derived from the driver tables.

Every view is one SELECT. Text that both SQL dialects accept is stored once;
where they differ the view holds a (spark, duckdb) pair, so that the
registered check SQL can repeat the derivation as a common table expression.
``[[t]]`` names a driver table and ``{v_x}`` another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str | tuple[str, str]] = {}

VIEWS["v_document_info"] = """
SELECT d.doc_id AS id, 'doc' || cast(d.doc_id AS string) AS document_id,
  'D' || lpad(cast(d.doc_id AS string), 8, '0') AS doc_code,
  cast(d.doc_id % 5 AS string) AS tenant_code, d.lang AS system_type,
  'file_' || cast(d.doc_id AS string) || '.' || d.ext AS file_name,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL
       ELSE 'D' || lpad(cast(d.doc_id AS string), 8, '0') || '.' || d.ext END AS stored_file_name,
  substring(d.text, 1, 30) AS title, d.n_chars AS file_size, d.text AS content,
  CASE WHEN l.quality IS NULL THEN 'PROCESSING' WHEN l.quality = 1 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  coalesce(l.quality = 1 AND l.toxic <> 1, false) AS enabled,
  cast(floor((d.n_chars + 999) / 1000) AS bigint) AS chunk_count,
  'u' || cast(d.doc_id % 50 AS string) AS user_id,
  timestamp '2024-01-01 00:00:00' + d.doc_id * interval '1' minute AS created_time,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE cast(d.doc_id % 2 AS int) END AS retry_count
FROM (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'txt' WHEN 1 THEN 'MD' WHEN 2 THEN 'csv' WHEN 3 THEN 'pdf'
        WHEN 4 THEN 'doc' WHEN 5 THEN 'docx' WHEN 6 THEN 'xls' WHEN 7 THEN 'xlsx' WHEN 8 THEN 'ppt'
        ELSE 'exe' END AS ext FROM [[documents]]) d
LEFT JOIN [[labels]] l ON l.doc_id = d.doc_id
"""

VIEWS["v_structured_doc"] = ("""
SELECT 'D' || lpad(cast(doc_id AS string), 8, '0') AS doc_code, lang AS system_type,
  array_join(transform(split(text, '\\n', -1), (l, i) -> concat(
    CASE WHEN i % 15 = 14 THEN concat('[[PAGE:', cast(i div 15 + 2 AS string), ']]\\n') ELSE '' END,
    CASE WHEN i % 6 = 3 THEN concat(repeat('#', 1 + (i div 6) % 3), ' Part ', cast(i div 6 AS string), '\\n') ELSE '' END,
    l)), '\\n') AS text
FROM [[documents]]
""", """
SELECT 'D' || lpad(cast(doc_id AS string), 8, '0') AS doc_code, lang AS system_type,
  array_to_string(list_transform(string_split(text, chr(10)), lambda l, j: concat(
    CASE WHEN (j-1) % 15 = 14 THEN concat('[[PAGE:', cast((j-1) // 15 + 2 AS string), ']]' || chr(10)) ELSE '' END,
    CASE WHEN (j-1) % 6 = 3 THEN concat(repeat('#', cast(1 + ((j-1) // 6) % 3 AS int)), ' Part ', cast((j-1) // 6 AS string), chr(10)) ELSE '' END,
    l)), chr(10)) AS text
FROM [[documents]]
""")

VIEWS["v_chunk_vec"] = """
SELECT 'c' || lpad(cast(e.vec_id AS string), 8, '0') AS chunk_id, e.vec_id, e.label, e.embedding,
  'D' || lpad(cast(cast(floor(e.vec_id / 10) AS bigint) AS string), 8, '0') AS doc_code,
  cast(e.vec_id % 10 AS int) AS chunk_index, cast(e.vec_id % 5 AS string) AS tenant_code,
  's' || cast(e.label % 2 AS string) AS system_type, e.vec_id % 11 <> 0 AS enabled,
  CASE WHEN e.vec_id % 13 = 0 THEN 'PROCESSING' ELSE 'SUCCESS' END AS status,
  CASE WHEN e.vec_id % 8 = 7 THEN ' ' WHEN e.vec_id % 8 = 6 THEN NULL
       ELSE 'p' || lpad(cast(cast(floor(e.vec_id / 5) AS bigint) AS string), 8, '0') END AS parent_chunk_id,
  CASE WHEN e.vec_id % 9 = 0 THEN NULL ELSE 'file_' || cast(e.vec_id AS string) || '.md' END AS file_name,
  CASE WHEN e.vec_id % 7 = 0 THEN NULL ELSE 'title ' || cast(e.vec_id AS string) END AS title,
  CASE WHEN e.vec_id % 6 = 0 THEN NULL ELSE cast(e.vec_id % 4 + 1 AS string) END AS page_number,
  'h' || cast(e.vec_id % 3 AS string) AS title_hierarchy, d.text AS content
FROM [[embeddings]] e LEFT JOIN [[documents]] d ON d.doc_id = e.vec_id
"""

VIEWS["v_coarse_chunk"] = """
SELECT 'p' || lpad(cast(k AS string), 8, '0') AS chunk_id, d.text AS content
FROM (SELECT DISTINCT cast(floor(vec_id / 5) AS bigint) AS k FROM [[embeddings]]) t LEFT JOIN [[documents]] d ON d.doc_id = t.k
"""

# One question per label; its variant vectors are the label's component sums in integer
# micro-units, which are exact whatever the order of summation.
VIEWS["v_question"] = """
SELECT e.label AS query_id, cast(e.label % 5 AS string) AS tenant_code, 's' || cast(e.label % 2 AS string) AS system_type,
  'Please tell me about ' || replace(min(d.text), chr(10), ' ') || '?' AS question
FROM [[embeddings]] e JOIN [[documents]] d ON d.doc_id = e.vec_id GROUP BY e.label
"""

VIEWS["v_query_vec"] = ("""
SELECT query_id, query_pos, cast(query_id % 5 AS string) AS tenant_code, 's' || cast(query_id % 2 AS string) AS system_type,
  transform(array_sort(collect_list(struct(i, s))), x -> cast(x.s AS double)) AS embedding
FROM (SELECT label AS query_id, cast(vec_id % 3 AS int) AS query_pos, i,
        sum(cast(floor(cast(x AS double) * 1000000.0D + 0.5D) AS bigint)) AS s
      FROM [[embeddings]] LATERAL VIEW posexplode(embedding) t AS i, x GROUP BY 1, 2, 3) u
GROUP BY query_id, query_pos
""", """
SELECT query_id, query_pos, cast(query_id % 5 AS string) AS tenant_code, 's' || cast(query_id % 2 AS string) AS system_type,
  list(cast(s AS double) ORDER BY i) AS embedding
FROM (SELECT label AS query_id, cast(vec_id % 3 AS int) AS query_pos, i,
        cast(sum(cast(floor(cast(x AS double) * 1000000.0 + 0.5) AS bigint)) AS bigint) AS s
      FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM [[embeddings]]) e
      GROUP BY 1, 2, 3) u
GROUP BY query_id, query_pos
""")

VIEWS["v_rerank_score"] = """
SELECT label AS query_id, chunk_id,
  CASE WHEN vec_id % 10 = 3 THEN NULL ELSE cast((vec_id * 37) % 101 AS double) / 100 END AS rerank_score
FROM {v_chunk_vec} c WHERE system_type = 's0'
"""

VIEWS["v_vec_mention"] = """
SELECT 'c' || lpad(cast(vec_id AS string), 8, '0') AS chunk_id, 'E' || cast(vec_id % 37 AS string) AS entity_name FROM [[embeddings]]
UNION SELECT 'c' || lpad(cast(vec_id AS string), 8, '0'), 'E' || cast(50 + vec_id % 23 AS string) FROM [[embeddings]]
"""
VIEWS["v_vec_relation"] = """
SELECT DISTINCT 'E' || cast(vec_id % 37 AS string) AS src, 'E' || cast(50 + vec_id % 23 AS string) AS dst, 'near' AS type FROM [[embeddings]]
"""
VIEWS["v_mention"] = """
SELECT DISTINCT 'O' || cast(l_orderkey AS string) AS chunk_id, 'P' || cast(l_partkey AS string) AS entity_name FROM [[lineitem]]
"""
VIEWS["v_entity"] = """
SELECT 'P' || cast(p_partkey AS string) AS name, p_type AS type FROM [[part]]
"""
VIEWS["v_relation"] = """
SELECT src, dst, min(type) AS type FROM (
  SELECT 'P' || cast(p_partkey AS string) AS src,
    'P' || cast((p_partkey * 7 + 1) % (SELECT count(*) FROM [[part]]) AS string) AS dst, p_type AS type FROM [[part]]
  UNION ALL
  SELECT 'P' || cast(p_partkey AS string) AS src,
    'P' || cast((p_partkey + 3) % (SELECT count(*) FROM [[part]]) AS string) AS dst, p_type AS type FROM [[part]]) r
GROUP BY src, dst
"""
VIEWS["v_graph_chunk"] = """
SELECT 'O' || cast(o_orderkey AS string) AS chunk_id,
  o_orderpriority || ' ' || cast(cast(floor(o_orderkey / 3) AS bigint) AS string) AS content,
  'D' || cast(o_custkey AS string) AS doc_code, cast(o_orderkey % 10 AS int) AS chunk_index,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'file_' || cast(o_custkey AS string) || '.md' END AS file_name,
  cast(o_custkey % 5 AS string) AS tenant_code, o_orderstatus AS system_type, o_orderkey % 17 <> 0 AS enabled
FROM [[orders]]
"""
VIEWS["v_seed"] = """
SELECT o_custkey AS query_id, 'O' || cast(o_orderkey AS string) AS chunk_id, cast(o_custkey % 5 AS string) AS tenant_code,
  CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS system_type
FROM [[orders]]
"""
VIEWS["v_extraction_json"] = ("""
SELECT 'B' || lpad(cast(b AS string), 8, '0') AS batch_id, 'D' || cast(b % 100 AS string) AS doc_code,
  CASE WHEN b % 20 = 19 THEN '{"entities":[{"name":' ELSE '{"entities":[' || array_join(transform(a, x -> x.e), ',') || '],"relations":['
    || array_join(transform(a, x -> x.r), ',') || ']}' END AS extraction
FROM (SELECT b, array_sort(collect_list(struct(k, e, r))) AS a FROM (
  SELECT cast(floor(p_partkey / 4) AS bigint) AS b, p_partkey AS k,
    '{"name":"' || CASE WHEN p_partkey % 20 = 7 THEN '  ' ELSE ' ' || p_name || ' ' || cast(p_partkey % 300 AS string) END
      || '","type":' || CASE WHEN p_partkey % 11 = 0 THEN 'null' ELSE '"' || p_type || '"' END || ',"extra":' || cast(p_size AS string) || '}' AS e,
    '{"source":"' || p_name || ' ' || cast(p_partkey % 300 AS string) || '","target":"' || p_name || ' ' || cast((p_partkey + 1) % 300 AS string)
      || '","type":"' || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END || '"}' AS r
  FROM [[part]]) p GROUP BY b) g
""", """
SELECT 'B' || lpad(cast(b AS string), 8, '0') AS batch_id, 'D' || cast(b % 100 AS string) AS doc_code,
  CASE WHEN b % 20 = 19 THEN '{"entities":[{"name":' ELSE '{"entities":[' || string_agg(e, ',' ORDER BY k) || '],"relations":['
    || string_agg(r, ',' ORDER BY k) || ']}' END AS extraction
FROM (
  SELECT cast(floor(p_partkey / 4) AS bigint) AS b, p_partkey AS k,
    '{"name":"' || CASE WHEN p_partkey % 20 = 7 THEN '  ' ELSE ' ' || p_name || ' ' || cast(p_partkey % 300 AS string) END
      || '","type":' || CASE WHEN p_partkey % 11 = 0 THEN 'null' ELSE '"' || p_type || '"' END || ',"extra":' || cast(p_size AS string) || '}' AS e,
    '{"source":"' || p_name || ' ' || cast(p_partkey % 300 AS string) || '","target":"' || p_name || ' ' || cast((p_partkey + 1) % 300 AS string)
      || '","type":"' || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END || '"}' AS r
  FROM [[part]]) p GROUP BY b
""")

VIEWS["v_api_key"] = """
SELECT c_custkey AS id, c_name AS name, cast(c_nationkey AS string) AS tenant_code, c_mktsegment AS system_type,
  c_custkey % 10 <> 0 AS enabled, c_custkey % 13 = 0 AS is_delete,
  CASE c_custkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 5000000 ELSE 50000000 END AS quota_e8
FROM [[customer]]
"""
VIEWS["v_api_key_usage"] = """
SELECT o.o_custkey AS api_key_id, 's' || cast(l.l_orderkey AS string) AS session_id, 'u' || cast(o.o_custkey % 200 AS string) AS user_id,
  CASE l.l_partkey % 6 WHEN 0 THEN 'deepseek-v4.1-flash' WHEN 1 THEN 'DeepSeek-v4-flash-0731' WHEN 2 THEN 'glm-5.3-flash'
    WHEN 3 THEN 'ernie-4.5-turbo-20260402' WHEN 4 THEN 'ernie-4.5-turbo-128k' ELSE 'other-model' END AS model,
  cast(l.l_quantity AS bigint) * 40 AS prompt_tokens, l.l_linenumber * 50 + l.l_partkey % 100 AS completion_tokens,
  cast(l.l_quantity AS bigint) * 40 + l.l_linenumber * 50 + l.l_partkey % 100 AS total_tokens,
  (l.l_suppkey % 3) * l.l_linenumber * 100 AS cache_tokens,
  l.l_shipdate + l.l_linenumber * interval '1' second AS created_time,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM [[lineitem]] l JOIN [[orders]] o ON o.o_orderkey = l.l_orderkey
"""
# Known models with prices in 1e-8 units per token (input, output, cached input).
VIEWS["v_model_price"] = """
SELECT * FROM (VALUES ('deepseek-v4.1-flash', 200, 800, 20), ('deepseek-v4-flash-0731', 300, 900, 30),
  ('glm-5.3-flash', 80, 280, 23), ('ernie-4.5-turbo-20260402', 80, 320, 20), ('ernie-4.5-turbo-128k', 80, 320, 20))
  AS t(model, in_e8, out_e8, cache_e8)
"""
VIEWS["v_quota_log"] = """
SELECT o_orderkey AS id, o_custkey AS api_key_id, CASE WHEN o_orderstatus = 'F' THEN 'SET' ELSE 'ADD' END AS type,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 8 = 0 THEN -1 ELSE cast(floor(o_totalprice * 100 + 0.5) AS bigint) END AS amount_cents,
  o_orderdate AS created_time
FROM [[orders]]
"""
VIEWS["v_chat_message"] = """
SELECT u.conv_id * 100 + u.turn AS id, cast(u.conv_id AS string) AS session_id, 'u' || cast(u.conv_id % 20 AS string) AS user_id,
  CASE WHEN u.turn % 4 = 0 AND u.conv_id % 2 = 0 THEN 'topic ' || cast(u.conv_id % 30 AS string) ELSE '' END AS title,
  u.text AS question, CASE WHEN a.role = 'assistant' THEN a.text ELSE '' END AS answer,
  cast(u.conv_id % 5 AS string) AS tenant_code, 's' || cast(u.conv_id % 2 AS string) AS system_type,
  CASE WHEN u.conv_id % 3 = 0 THEN NULL ELSE u.conv_id % 100 END AS api_key_id,
  timestamp '2024-01-01 00:00:00' + u.conv_id * interval '1' hour + u.turn * interval '1' minute AS create_time,
  CASE WHEN u.conv_id % 11 = 0 THEN '[]' ELSE
  '[{"docCode":"D' || lpad(cast((u.conv_id * 7 + u.turn) % (SELECT count(*) FROM [[documents]]) AS string), 8, '0')
    || '","deleted":false},{"docCode":"D' || lpad(cast((u.conv_id * 7 + u.turn + 1) % (SELECT count(*) FROM [[documents]]) AS string), 8, '0')
    || '","deleted":false}]' END AS sources
FROM [[conversations]] u LEFT JOIN [[conversations]] a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user'
"""
VIEWS["v_long_session"] = """
SELECT event_id AS id, 's' || cast(user_id AS string) AS session_id, event_type || ' ' || cast(event_id AS string) AS question,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS answer, ts AS create_time
FROM [[events]]
"""
VIEWS["v_session_summary"] = """
SELECT 's' || cast(user_id AS string) AS session_id,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'summary of user ' || cast(user_id AS string) END AS summary,
  count(*) - user_id % 15 AS last_message_count
FROM [[events]] GROUP BY user_id
"""
VIEWS["v_unanswered"] = """
SELECT event_id AS id, 'q' || cast(event_id % 40 AS string) AS question, cast(user_id % 5 AS string) AS tenant_code,
  ts AS create_time, props AS answer
FROM [[events]] WHERE event_type = 'error'
"""
VIEWS["v_tenant"] = """
SELECT cast(n_nationkey AS bigint) AS id, cast(n_nationkey + 1 AS string) AS tenant_code, n_name AS tenant_name, n_regionkey <> 3 AS enabled
FROM [[nation]]
"""
VIEWS["v_tenant_request"] = """
SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 12 = 0 THEN '' ELSE cast(s_suppkey % 40 AS string) END AS tenant_code,
  CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS tenant_name
FROM [[supplier]]
"""
VIEWS["v_fragment"] = ("""
SELECT conv_id AS session_id, turn AS seq, array_join(collect_list(text) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS text FROM [[conversations]]
""", """
SELECT conv_id AS session_id, turn AS seq, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS text FROM [[conversations]]
""")
VIEWS["v_chunk_row"] = """
SELECT 'doc' || cast(l_orderkey AS string) AS document_id, cast(l_linenumber - 2 AS int) AS chunk_index,
  CASE WHEN l_returnflag = 'A' THEN 'COARSE' ELSE 'FINE' END AS chunk_type,
  'k' || lpad(cast(l_partkey AS string), 8, '0') || lpad(cast(l_suppkey AS string), 6, '0')
    || lpad(cast(cast(floor(l_extendedprice * 100 + 0.5) AS bigint) AS string), 12, '0') AS chunk_id,
  'D' || lpad(cast(l_orderkey AS string), 8, '0') AS doc_code,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 'file_' || cast(l_partkey AS string) || '.md' END AS file_name,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'title ' || cast(l_suppkey AS string) END AS title,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE cast(l_orderkey % 5 AS string) END AS tenant_code,
  CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_linestatus END AS system_type,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'SUCCESS' END AS status,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_returnflag END AS description, CASE WHEN l_partkey % 7 = 1 THEN l_linestatus END AS error_message,
  'u' || cast(l_suppkey % 9 AS string) AS user_id, l_partkey % 5 <> 0 AS enabled,
  l_shipdate AS upload_time, cast(l_quantity AS bigint) AS file_size
FROM [[lineitem]]
"""
VIEWS["v_status_event"] = """
SELECT cast(user_id AS string) || '-' || cast(cast(floor(event_id / 50) AS bigint) AS string) AS doc_code, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'PROCESSING' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILED' END AS status
FROM [[events]] WHERE event_type IN ('signup', 'purchase', 'error')
"""

_REF = re.compile(r"\{(v_\w+)\}")
_BASE = re.compile(r"\[\[(\w+)\]\]")


def _text(name: str, dialect: int) -> str:
    v = VIEWS[name]
    return v if isinstance(v, str) else v[dialect]


def _needed(names: list[str], dialect: int) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for dep in _REF.findall(_text(n, dialect)):
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """The named view as a lazy DataFrame over the parquet tables.

    With ``by`` the rows of a SELECT DISTINCT are dealt out by that column before equal ones are dropped: the same rows, and what meets them by the
    column needs no second shuffle.
    """
    sql = _BASE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", _text(name, 0))
    frames = {d: view(spark, sf_dir, d) for d in _REF.findall(sql)}
    if by is not None:
        head, distinct, rest = sql.partition("SELECT DISTINCT")
        if head.strip() or not distinct:
            raise ValueError(f"{name} is not a SELECT DISTINCT")
        return spark.sql(f"SELECT{rest}", **frames).repartition(by).distinct()
    return spark.sql(sql, **frames) if frames else spark.sql(sql)


def check_sql(body: str, *views: str) -> str:
    """``body`` preceded by the views it names as common table expressions."""
    parts = []
    for n in _needed(list(views), 1):
        text = _BASE.sub(r"\1", _REF.sub(r"\1", _text(n, 1))).strip()
        parts.append(f"{n} AS ({text})")
    head = body.lstrip()
    if not parts:
        return head
    if head[:14].upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + head[14:]
    if head[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + head[5:]
    return "WITH " + ",\n".join(parts) + "\n" + head
