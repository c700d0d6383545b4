"""Entity graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.operators import graph as G
from kbspark.operators import maintenance as M
from kbspark.sources.fixtures import view
from kbspark.sources.tables import read_table

GV = "v_graph_chunk v_mention v_relation v_entity v_seed"


def _graph(spark, d):
    return (view(spark, d, "v_graph_chunk"), view(spark, d, "v_mention"), view(spark, d, "v_entity"), view(spark, d, "v_relation"))


@register("j3_multi_hop", """WITH seed AS (SELECT s.query_id, s.tenant_code AS t, s.system_type AS s, c.chunk_id, c.content FROM v_seed s
    JOIN v_graph_chunk c ON c.chunk_id = s.chunk_id
    WHERE c.enabled AND (s.tenant_code = '0' OR (c.tenant_code = s.tenant_code AND c.system_type = s.system_type) OR c.tenant_code = '0')),
  reach AS (SELECT src AS e1, dst AS e2 FROM v_relation UNION SELECT a.src, b.dst FROM v_relation a JOIN v_relation b ON b.src = a.dst
    WHERE NOT (a.src = b.src AND a.dst = b.dst)),
  starts AS (SELECT query_id, t, s, content, entity_name AS e1, min(seed.chunk_id) AS source_id FROM seed JOIN v_mention m ON m.chunk_id = seed.chunk_id GROUP BY ALL),
  others AS (SELECT m.entity_name AS e2, c.content, c.tenant_code, c.system_type, min(c.chunk_id) AS other_id FROM v_mention m
    JOIN v_graph_chunk c ON c.chunk_id = m.chunk_id WHERE c.enabled GROUP BY ALL),
  paths AS (SELECT query_id, content, e1, e2, oc, min(source_id) AS source_id, min(other_id) AS other_id FROM (
    SELECT b.*, r.e2, o.content AS oc, o.other_id FROM starts b LEFT JOIN reach r ON r.e1 = b.e1 LEFT JOIN others o ON o.e2 = r.e2
      AND (b.t = '0' OR (o.tenant_code = b.t AND o.system_type = b.s) OR o.tenant_code = '0')) x GROUP BY ALL)
  SELECT query_id, cast(rank AS int) AS rank, content AS source_content, e1 AS entity1, e2 AS entity2, oc AS other_content FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_id, e1, content, e2 NULLS FIRST, other_id NULLS FIRST) AS rank FROM paths) t WHERE rank <= 30""", GV)
def j3(spark, d):
    chunks, _, _, relations = _graph(spark, d)
    mentions = view(spark, d, "v_mention", by="chunk_id")  # the search meets them by chunk
    return G.multi_hop(view(spark, d, "v_seed"), chunks, mentions, relations, 30)


@register("j4_exclusive_entities", """SELECT entity_name, min(doc_code) AS doc_code FROM v_mention m JOIN v_graph_chunk c ON c.chunk_id = m.chunk_id
  GROUP BY entity_name HAVING count(DISTINCT doc_code) = 1
  UNION ALL SELECT 'chunk ' || m.chunk_id, min(c.doc_code) FROM v_mention m JOIN v_graph_chunk c ON c.chunk_id = m.chunk_id GROUP BY m.chunk_id""", GV)
def j4(spark, d):
    """Exclusive parts, and every chunk as an entity of its own document, which is exclusive by construction."""
    chunks, mentions, _, _ = _graph(spark, d)
    own = mentions.select("chunk_id", F.concat(F.lit("chunk "), "chunk_id").alias("entity_name")).distinct()
    return M.exclusive_entities(mentions.unionByName(own), chunks)


RELATIONS = """m AS (SELECT m.entity_name, c.tenant_code, c.system_type FROM v_mention m JOIN v_graph_chunk c ON c.chunk_id = m.chunk_id),
  visible AS (SELECT * FROM v_relation WHERE (src IN (SELECT entity_name FROM m WHERE tenant_code IN ('1', '0')) OR dst IN (SELECT entity_name FROM m WHERE tenant_code IN ('1', '0')))
    AND (src IN (SELECT entity_name FROM m WHERE system_type = 'P') OR dst IN (SELECT entity_name FROM m WHERE system_type = 'P')))"""


@register("j5_visible_relations", f"WITH {RELATIONS} SELECT src, dst, type FROM visible", GV)
def j5(spark, d):
    chunks, mentions, _, relations = _graph(spark, d)
    return G.visible_relations(relations, mentions, chunks, "1", "P").select("src", "dst", "type")


@register("r13_parse_extraction", """WITH x AS (SELECT batch_id, extraction FROM v_extraction_json WHERE json_valid(extraction)),
  e AS (SELECT batch_id, i - 1 AS pos, trim(json_extract_string(extraction, '$.entities[' || cast(i - 1 AS string) || '].name')) AS name,
    json_extract_string(extraction, '$.entities[' || cast(i - 1 AS string) || '].type') AS type
    FROM (SELECT *, unnest(range(1, 1 + cast(json_array_length(extraction, '$.entities') AS bigint))) AS i FROM x) t),
  r AS (SELECT batch_id, i - 1 AS pos, trim(json_extract_string(extraction, '$.relations[' || cast(i - 1 AS string) || '].source')) AS src,
    trim(json_extract_string(extraction, '$.relations[' || cast(i - 1 AS string) || '].target')) AS dst,
    json_extract_string(extraction, '$.relations[' || cast(i - 1 AS string) || '].type') AS type
    FROM (SELECT *, unnest(range(1, 1 + cast(json_array_length(extraction, '$.relations') AS bigint))) AS i FROM x) t)
  SELECT 'entity' AS kind, batch_id, cast(pos AS int) AS pos, name AS a, '' AS b, coalesce(type, 'unknown') AS type FROM e WHERE name <> ''
  UNION ALL SELECT 'relation', batch_id, cast(pos AS int), src, dst, coalesce(nullif(type, ''), 'related') FROM r WHERE src <> '' AND dst <> ''""", "v_extraction_json")
def r13(spark, d):
    e, r = G.parse_extraction(view(spark, d, "v_extraction_json"), ["batch_id"])
    return (e.select(F.lit("entity").alias("kind"), "batch_id", "pos", F.col("name").alias("a"), F.lit("").alias("b"), "type")
            .unionByName(r.select(F.lit("relation").alias("kind"), "batch_id", "pos", F.col("src").alias("a"), F.col("dst").alias("b"), "type")))


ENT = """ent AS (SELECT batch_id, pos, name, type FROM (SELECT batch_id, i - 1 AS pos, trim(json_extract_string(extraction, '$.entities[' || cast(i - 1 AS string) || '].name')) AS name,
    coalesce(json_extract_string(extraction, '$.entities[' || cast(i - 1 AS string) || '].type'), 'unknown') AS type
    FROM (SELECT *, unnest(range(1, 1 + cast(json_array_length(extraction, '$.entities') AS bigint))) AS i FROM v_extraction_json WHERE json_valid(extraction)) t) u WHERE name <> ''),
  stored AS (SELECT min(p_name || ' ' || cast(p_partkey AS string)) AS name, 'stored' AS type FROM part GROUP BY p_name),
  merged AS (SELECT * FROM stored UNION ALL SELECT name, arg_min(type, (batch_id, pos)) FROM ent WHERE name NOT IN (SELECT name FROM stored) GROUP BY name)"""


def _merged_entities(spark, d):
    e, r = G.parse_extraction(view(spark, d, "v_extraction_json"), ["batch_id"])
    label = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    stored = read_table(spark, d, "part").groupBy("p_name").agg(F.min(label).alias("name")).select("name", F.lit("stored").alias("type"))
    return G.merge_entities(e, ["batch_id", "pos"], stored), r


@register("j12_merge_entities", f"WITH {ENT} SELECT name, type FROM merged", "v_extraction_json")
def j12(spark, d):
    return _merged_entities(spark, d)[0]


@register("j13_known_endpoints", f"""WITH {ENT}, rel AS (SELECT batch_id, i AS pos, trim(json_extract_string(extraction, '$.relations[' || cast(i - 1 AS string) || '].source')) AS src,
    trim(json_extract_string(extraction, '$.relations[' || cast(i - 1 AS string) || '].target')) AS dst,
    coalesce(nullif(json_extract_string(extraction, '$.relations[' || cast(i - 1 AS string) || '].type'), ''), 'related') AS type
    FROM (SELECT *, unnest(range(1, 1 + cast(json_array_length(extraction, '$.relations') AS bigint))) AS i FROM v_extraction_json WHERE json_valid(extraction)) t)
  SELECT src, dst, arg_max(type, (batch_id, pos)) AS type FROM rel WHERE src IN (SELECT name FROM merged) AND dst IN (SELECT name FROM merged) GROUP BY src, dst""", "v_extraction_json")
def j13(spark, d):
    entities, r = _merged_entities(spark, d)
    return G.merge_edges(G.known_endpoints(r, entities), "batch_id", "pos")


BATCHED = """fine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_code ORDER BY chunk_index, chunk_id) AS rn FROM {src} WHERE chunk_index >= 0) t {cap}),
  counted AS (SELECT *, count(*) OVER (PARTITION BY doc_code) AS n FROM fine),
  batched AS (SELECT *, cast(floor((rn - 1) / CASE WHEN n <= 50 THEN 3 WHEN n <= 150 THEN 5 ELSE 8 END) AS int) AS batch_no FROM counted),
  texts AS (SELECT doc_code, batch_no, string_agg(content, chr(10) || '---' || chr(10) ORDER BY rn) AS text, list(chunk_id ORDER BY rn) AS chunk_ids
    FROM batched GROUP BY 1, 2)"""
# Orders of one status and priority stand for a document, so batches of every size occur.
BIG = """big AS (SELECT chunk_id, content, chunk_index, CASE WHEN length(doc_code) <= 3 THEN 'big' || substring(doc_code, 2, 1) WHEN length(doc_code) = 4 THEN 'mid' || substring(doc_code, 2, 2)
  ELSE doc_code END AS doc_code FROM v_graph_chunk)"""


def _big(spark, d):
    n = F.length("doc_code")
    code = (F.when(n <= 3, F.concat(F.lit("big"), F.substring("doc_code", 2, 1)))
            .when(n == 4, F.concat(F.lit("mid"), F.substring("doc_code", 2, 2))).otherwise(F.col("doc_code")))
    return view(spark, d, "v_graph_chunk").select("chunk_id", "content", "chunk_index", code.alias("doc_code"))


@register("w11_first_chunks_per_document", f"WITH {BIG}, {BATCHED.format(src='big', cap='WHERE rn <= 200')} SELECT doc_code, chunk_id, cast(rn AS int) AS rn, n, batch_no FROM batched", GV)
def w11(spark, d):
    return G.extraction_batches(_big(spark, d), 200).select("doc_code", "chunk_id", "rn", "n", "batch_no")


@register("a12_extraction_batches", f"WITH {BIG}, {BATCHED.format(src='big', cap='')} SELECT doc_code, batch_no, text, array_to_string(chunk_ids, ',') AS chunk_ids FROM texts", GV)
def a12(spark, d):
    return (G.batch_texts(G.extraction_batches(_big(spark, d)))
            .select("doc_code", "batch_no", "text", F.array_join("chunk_ids", ",").alias("chunk_ids")))


PHRASES = BATCHED.format(src="v_chunk_vec", cap="") + r""", words AS (SELECT doc_code, batch_no, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}])(\p{Lu}[\p{L}\p{N}]{3,})', 1)) AS w FROM texts
    WHERE trim(text) <> ''),
  top AS (SELECT * FROM (SELECT doc_code, batch_no, w, row_number() OVER (PARTITION BY doc_code, batch_no ORDER BY count(*) DESC, w) AS r FROM words GROUP BY 1, 2, 3) t)"""


@register("r14_extract_entities", f"""WITH {PHRASES} SELECT doc_code, batch_no, array_to_string(list(w ORDER BY r), ' ') AS names, count(*) AS n FROM top GROUP BY 1, 2""", "v_chunk_vec")
def r14(spark, d):
    found = G.phrase_extraction(G.batch_texts(G.extraction_batches(view(spark, d, "v_chunk_vec"))))
    e, _ = G.parse_extraction(found, ["doc_code", "batch_no"])
    return (e.groupBy("doc_code", "batch_no").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("a"))
            .select("doc_code", "batch_no", F.array_join(F.transform("a", lambda x: x["name"]), " ").alias("names"),
                    F.size("a").cast("bigint").alias("n")))


@register("r15_build_graph", f"""WITH {PHRASES}, edges AS (SELECT DISTINCT a.w AS src, b.w AS dst FROM top a JOIN top b ON b.doc_code = a.doc_code AND b.batch_no = a.batch_no AND b.r = a.r + 1)
  SELECT 'entity' AS kind, w AS a, 'term' AS b FROM top GROUP BY w
  UNION ALL SELECT DISTINCT 'mention', c, w FROM (SELECT t.w, unnest(x.chunk_ids) AS c FROM top t JOIN texts x ON x.doc_code = t.doc_code AND x.batch_no = t.batch_no) m
  UNION ALL SELECT 'relation', src, dst FROM edges""", "v_chunk_vec")
def r15(spark, d):
    e, m, r, _ = G.build_graph(view(spark, d, "v_chunk_vec"))
    return (e.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"))
            .unionByName(m.select(F.lit("mention").alias("kind"), F.col("chunk_id").alias("a"), F.col("entity_name").alias("b")))
            .unionByName(r.select(F.lit("relation").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))))


VIEWED = RELATIONS + """, mrows AS (SELECT c.chunk_id, c.file_name, c.content, c.chunk_index, m.entity_name, e.type FROM v_mention m JOIN v_graph_chunk c ON c.chunk_id = m.chunk_id
    LEFT JOIN v_entity e ON e.name = m.entity_name WHERE (c.tenant_code = '1' OR c.tenant_code = '0') AND c.system_type = 'P'),
  rrows AS (SELECT * FROM visible),
  nodes AS (SELECT DISTINCT 'chunk_' || chunk_id AS id, coalesce(file_name, 'chunk') || '#' || cast(chunk_index AS string) AS label, 'chunk' AS "group", NULL AS type,
      CASE WHEN length(content) > 60 THEN substring(content, 1, 60) || '...' ELSE content END AS title, 0 AS pri FROM mrows
    UNION ALL SELECT DISTINCT 'entity_' || entity_name, entity_name, 'entity', coalesce(type, 'unknown'), NULL, 0 FROM mrows
    UNION ALL SELECT DISTINCT 'entity_' || x, x, 'entity', 'unknown', NULL, 1 FROM (SELECT src AS x FROM rrows UNION SELECT dst FROM rrows) y)"""


@register("r16_graph_view_nodes", f"""WITH {VIEWED} SELECT id, label, "group", type, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pri) AS rn FROM nodes) t WHERE rn = 1""", GV)
def r16_nodes(spark, d):
    c, m, e, r = _graph(spark, d)
    return G.graph_view(c, m, e, r, "1", "P")[0]


@register("r16_graph_view_edges", f"""WITH {VIEWED} SELECT 'chunk_' || chunk_id AS "from", 'entity_' || entity_name AS "to", 'mentions' AS label FROM mrows
  UNION ALL SELECT 'entity_' || src, 'entity_' || dst, type FROM rrows""", GV)
def r16_edges(spark, d):
    c, m, e, r = _graph(spark, d)
    return G.graph_view(c, m, e, r, "1", "P")[1]


@register("u2_node_union", f"""WITH n AS (SELECT 'P' || cast(l_partkey AS string) AS id, min(l_returnflag) AS type, 0 AS pri FROM lineitem GROUP BY 1
  UNION ALL SELECT name, type, 1 FROM v_entity) SELECT id, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pri) AS rn FROM n) t WHERE rn = 1""", GV)
def u2(spark, d):
    seen = (read_table(spark, d, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id"))
            .agg(F.min("l_returnflag").alias("type")).withColumn("pri", F.lit(0)))
    every = view(spark, d, "v_entity").select(F.col("name").alias("id"), "type", F.lit(1).alias("pri"))
    return G.merge_nodes(seen.unionByName(every))


@register("w3_chunk_links", """SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY doc_code ORDER BY chunk_index) AS prev_chunk_id,
  lead(chunk_id) OVER (PARTITION BY doc_code ORDER BY chunk_index) AS next_chunk_id FROM v_chunk_vec""", "v_chunk_vec")
def w3(spark, d):
    from kbspark.operators.chunking import link_chunks

    return link_chunks(view(spark, d, "v_chunk_vec")).select("chunk_id", "prev_chunk_id", "next_chunk_id")

