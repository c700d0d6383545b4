"""Recall, re-ranking, context and question text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.functions import text as X
from kbspark.operators import retrieval as R
from kbspark.operators.layout import spread
from kbspark.operators.pruned import recall_from_store
from kbspark.plans import answer_context as A
from kbspark.sources import files
from kbspark.sources.fixtures import view
from kbspark.sources.store import ChunkStore
from kbspark.sources.tables import read_table

SETTINGS = A.RetrievalSettings(threshold=0.55, floor=0.55, external_threshold=0.4)
NOISE = ", ".join("'" + w + "'" for w in X.NOISE_WORDS)


def _alt(words):
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def topics_sql(c: str) -> str:
    """Distinct topic words in first-seen order."""
    l = f"list_filter(regexp_extract_all(lower({c}), '\\p{{L}}[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({NOISE}))"
    return f"list_filter({l}, lambda w, i: list_position({l}, w) = i)"


RAW = r"regexp_replace(question, '^\s+|\s+$', '', 'g')"
VARIANTS = rf"""raw_q AS (SELECT *, {RAW} AS raw FROM asked),
  std0 AS (SELECT *, regexp_extract(raw, '{X.question_pattern()}', 1) AS s0 FROM raw_q),
  std AS (SELECT *, CASE WHEN s0 = '' THEN raw ELSE s0 END AS standard FROM std0),
  kw0 AS (SELECT *, {topics_sql('raw')} AS k0 FROM std),
  kw AS (SELECT *, CASE WHEN len(k0) = 0 THEN [standard] ELSE k0 END AS k FROM kw0),
  lst AS (SELECT *, [standard, raw, array_to_string(k, ' '), CASE WHEN len(k) >= 2 THEN array_to_string(k[1:3], ' ') ELSE '' END] AS v0 FROM kw),
  variants AS (SELECT *, CASE WHEN raw = '' THEN [question] ELSE (list_filter(v0, lambda x, i: x <> '' AND list_position(v0, x) = i))[1:3] END AS v FROM lst)"""


@register("r1_query_rewrite", rf"""WITH asked AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Please can you ' || question || ' ok?! ' WHEN id % 50 = 2 THEN '  '
    ELSE question END AS question FROM v_chat_message), {VARIANTS}
  SELECT id, cast(i - 1 AS int) AS query_pos, v[i] AS query_text FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM variants) t""", "v_chat_message")
def r1(spark, d):
    q = (F.when(F.col("id") % 3 == 0, F.concat(F.lit("Please can you "), F.col("question"), F.lit(" ok?! ")))
         .when(F.col("id") % 50 == 2, "  ").otherwise(F.col("question")))
    return X.rewrite_queries(view(spark, d, "v_chat_message").select("id", q.alias("question")))


@register("r2_topic_words", f"""SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS words FROM (SELECT doc_id,
  list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({NOISE})))) AS w FROM documents) t""")
def r2(spark, d):
    w = F.array_sort("w")
    docs = spread(read_table(spark, d, "documents")).select("doc_id", X.topic_words("text").alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_join(w, " ").alias("words"))


VEC = "v_chunk_vec v_query_vec v_question v_rerank_score v_coarse_chunk v_vec_mention v_vec_relation"
HITS = """scored AS (SELECT cast(q.query_id AS bigint) AS query_id, q.query_pos, c.chunk_id, c.doc_code, c.chunk_index,
    round((1 + list_cosine_similarity(cast(c.embedding AS double[]), q.embedding)) / 2, 6) AS score
  FROM v_query_vec q JOIN v_chunk_vec c ON c.enabled AND c.status = 'SUCCESS' AND (c.tenant_code = q.tenant_code OR c.tenant_code = '0')
    AND c.system_type = q.system_type),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_pos ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score >= 0) t WHERE rank <= 20)"""
MERGED = HITS + """, merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_code, chunk_index
    ORDER BY query_pos, score DESC, chunk_id) AS rn FROM hits) t WHERE rn = 1)"""
CAND = MERGED + f""", qt AS (SELECT cast(query_id AS bigint) AS query_id, tenant_code, system_type, list_distinct({topics_sql("question")}) AS q_topics FROM v_question),
  cand AS (SELECT m.*, qt.tenant_code, c.tenant_code AS doc_tenant, c.content, c.parent_chunk_id, qt.q_topics,
    list_distinct(list_filter(regexp_extract_all(lower(coalesce(c.content, '')), '\\p{{L}}[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({NOISE}))) AS d_topics
    FROM merged m JOIN qt ON qt.query_id = m.query_id JOIN v_chunk_vec c ON c.chunk_id = m.chunk_id),
  topical AS (SELECT *, len(q_topics) = 0 OR len(d_topics) = 0 OR len(list_intersect(q_topics, d_topics)) >= 2
    OR (len(q_topics) <= 2 AND len(list_intersect(q_topics, d_topics)) = len(q_topics)) AS on_topic FROM cand)"""
LOCAL = CAND + """, local_rank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS lrank
    FROM topical WHERE score >= 0.55 AND on_topic) t WHERE lrank <= 5)"""
RANKED = LOCAL + """, ext_rank AS (SELECT t.*, row_number() OVER (PARTITION BY t.query_id ORDER BY s.rerank_score DESC NULLS LAST, t.chunk_id) AS erank
    FROM cand t JOIN v_rerank_score s ON s.query_id = t.query_id AND s.chunk_id = t.chunk_id
    WHERE trim(coalesce(t.content, '')) <> '' AND (s.rerank_score IS NULL OR s.rerank_score >= 0.4)),
  both_rank AS (SELECT query_id, chunk_id, tenant_code, doc_tenant, score, erank AS rank, 'external' AS source FROM ext_rank
    UNION ALL SELECT query_id, chunk_id, tenant_code, doc_tenant, score, lrank, 'local' FROM local_rank
    WHERE query_id NOT IN (SELECT query_id FROM v_rerank_score)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN tenant_code = '0' THEN 0 WHEN doc_tenant = tenant_code THEN 0 ELSE 1 END, rank) AS position
    FROM both_rank)"""


def _vec(spark, d):
    return view(spark, d, "v_chunk_vec"), view(spark, d, "v_query_vec"), view(spark, d, "v_question")


@register("r3_vector_recall", f"WITH {HITS} SELECT query_id, query_pos, chunk_id, score, cast(rank AS int) AS rank FROM hits", VEC)
def r3(spark, d):
    chunks, queries, _ = _vec(spark, d)
    return R.vector_recall(chunks, queries)


@register("r3_vector_recall_blocked", f"WITH {HITS} SELECT query_id, query_pos, chunk_id, score, cast(rank AS int) AS rank FROM hits", VEC)
def r3_blocked(spark, d):
    """The plan for more query vectors than a task may hold."""
    chunks, queries, _ = _vec(spark, d)
    return R.vector_recall(chunks, queries, broadcast_bytes=0)


@register("r3_recall_from_store", f"WITH {HITS} SELECT query_id, query_pos, chunk_id, score, cast(rank AS int) AS rank FROM hits", VEC)
def r3_store(spark, d):
    """Recall from a written store: folders pruned by tenant and system, cells by the triangle inequality."""
    chunks, queries, _ = _vec(spark, d)
    store = ChunkStore(spark, files.scratch_dir(spark, "r3-store"))
    store.upsert(chunks.select("chunk_id", "tenant_code", "system_type", "enabled", "status", "content", "embedding", F.lit("FINE").alias("chunk_type")))
    hits, _ = recall_from_store(store, queries)
    return hits.select("query_id", "query_pos", "chunk_id", "score", "rank")


@register("w9_top_k_per_query", """SELECT query_id, chunk_id, rerank_score, cast(rn AS int) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, chunk_id) AS rn FROM v_rerank_score) t WHERE rn <= 5""", VEC)
def w9(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "chunk_id")
    return view(spark, d, "v_rerank_score").withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


@register("u1_merge_query_variants", f"WITH {MERGED} SELECT query_id, doc_code, chunk_index, chunk_id, query_pos, score FROM merged", VEC)
def u1(spark, d):
    chunks, queries, _ = _vec(spark, d)
    return (R.merge_variants(R.vector_recall(chunks, queries), chunks)
            .select("query_id", "doc_code", "chunk_index", "chunk_id", "query_pos", "score"))


@register("r4_topic_overlap", f"WITH {CAND} SELECT query_id, chunk_id, on_topic FROM topical", VEC)
def r4(spark, d):
    chunks, queries, questions = _vec(spark, d)
    return A.candidates(questions, queries, chunks, SETTINGS).select(
        "query_id", "chunk_id", X.topics_overlap("query_topics", "doc_topics").alias("on_topic"))


@register("r5_local_rerank", f"WITH {LOCAL} SELECT query_id, chunk_id, score, cast(lrank AS int) AS rank FROM local_rank", VEC)
def r5(spark, d):
    chunks, queries, questions = _vec(spark, d)
    found = A.candidates(questions, queries, chunks, SETTINGS)
    return R.local_rerank(found, 5, 0.55, 0.55).select("query_id", "chunk_id", "score", "rank")


@register("r6_rerank_with_fallback", f"WITH {RANKED} SELECT query_id, chunk_id, score, source, cast(rank AS int) AS rank, cast(position AS int) AS position FROM ranked", VEC)
def r6(spark, d):
    chunks, queries, questions = _vec(spark, d)
    return (A.ranked_hits(questions, queries, chunks, view(spark, d, "v_rerank_score"), SETTINGS)
            .select("query_id", "chunk_id", "score", "source", "rank", "position"))


@register("j11_external_scores", f"WITH {RANKED} SELECT query_id, chunk_id, cast(erank AS int) AS rank FROM ext_rank", VEC)
def j11(spark, d):
    chunks, queries, questions = _vec(spark, d)
    found = A.candidates(questions, queries, chunks, SETTINGS)
    return R.external_rerank(found, view(spark, d, "v_rerank_score"), 0.4).select("query_id", "chunk_id", "rank")


PARENTS = """parents AS (SELECT m.query_id, p.content, min(p.chunk_id) AS chunk_id FROM {hits} m JOIN v_chunk_vec c ON c.chunk_id = m.chunk_id
  JOIN v_coarse_chunk p ON p.chunk_id = c.parent_chunk_id WHERE trim(coalesce(c.parent_chunk_id, '')) <> '' GROUP BY 1, 2)"""


@register("j2_parent_completion", f"WITH {MERGED}, {PARENTS.format(hits='merged')} SELECT query_id, content, chunk_id FROM parents", VEC)
def j2(spark, d):
    chunks, queries, _ = _vec(spark, d)
    hits = R.merge_variants(R.vector_recall(chunks, queries), chunks).select("query_id", "chunk_id").join(
        chunks.select("chunk_id", "parent_chunk_id"), "chunk_id")
    return R.parent_contents(hits, view(spark, d, "v_coarse_chunk"))


PATHS = """seed AS (SELECT r.query_id, q.tenant_code AS t, q.system_type AS s, c.chunk_id, c.content FROM ranked r JOIN qt q ON q.query_id = r.query_id
    JOIN v_chunk_vec c ON c.chunk_id = r.chunk_id WHERE c.enabled AND (q.tenant_code = '0' OR (c.tenant_code = q.tenant_code AND c.system_type = q.system_type) OR c.tenant_code = '0')),
  reach AS (SELECT src AS e1, dst AS e2 FROM v_vec_relation UNION SELECT a.src, b.dst FROM v_vec_relation a JOIN v_vec_relation b ON b.src = a.dst
    WHERE NOT (a.src = b.src AND a.dst = b.dst)),
  starts AS (SELECT query_id, t, s, content, entity_name AS e1, min(seed.chunk_id) AS source_id FROM seed JOIN v_vec_mention m ON m.chunk_id = seed.chunk_id GROUP BY ALL),
  others AS (SELECT m.entity_name AS e2, c.content, c.tenant_code, c.system_type, min(c.chunk_id) AS other_id FROM v_vec_mention m JOIN v_chunk_vec c ON c.chunk_id = m.chunk_id
    WHERE c.enabled GROUP BY ALL),
  paths AS (SELECT query_id, content AS source_content, e1, e2, oc AS other_content, min(source_id) AS source_id, min(other_id) AS other_id FROM (
    SELECT b.*, r.e2, o.content AS oc, o.other_id FROM starts b LEFT JOIN reach r ON r.e1 = b.e1 LEFT JOIN others o ON o.e2 = r.e2
      AND (b.t = '0' OR (o.tenant_code = b.t AND o.system_type = b.s) OR o.tenant_code = '0')) x GROUP BY ALL),
  hop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_id, e1, source_content, e2 NULLS FIRST, other_id NULLS FIRST) AS rank
    FROM paths) t WHERE rank <= 30)"""
CONTEXT = """texts AS (SELECT query_id, t, min(rank * 2 + side) AS first_at FROM (SELECT query_id, rank, 0 AS side, source_content AS t FROM hop
    UNION ALL SELECT query_id, rank, 1, other_content FROM hop) x WHERE t IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT query_id, string_agg(t, chr(10) || '***' || chr(10) ORDER BY first_at) AS g FROM texts GROUP BY 1),
  v AS (SELECT r.query_id, string_agg(c.content, chr(10) || '---' || chr(10) ORDER BY position) AS v, count(*) AS n_sources, max(source) AS rank_source
    FROM ranked r JOIN v_chunk_vec c ON c.chunk_id = r.chunk_id GROUP BY 1),
  p AS (SELECT query_id, string_agg(content, chr(10) || '---' || chr(10) ORDER BY chunk_id) AS p FROM parents GROUP BY 1)
  SELECT v.query_id, '[Retrieved passages]' || chr(10) || coalesce(v.v, '') || CASE WHEN coalesce(p.p, '') <> '' THEN chr(10) || '[Wider context]' || chr(10) || p.p ELSE '' END
    || chr(10) || '[Related by graph]' || chr(10) || coalesce(g.g, '') AS context, v.n_sources, v.rank_source
  FROM v LEFT JOIN p ON p.query_id = v.query_id LEFT JOIN g ON g.query_id = v.query_id"""


@register("r17_answer_contexts", f"WITH {RANKED}, {PARENTS.format(hits='ranked')}, {PATHS}, {CONTEXT}", VEC)
def r17(spark, d):
    chunks, queries, questions = _vec(spark, d)
    return A.answer_contexts(questions, queries, chunks, view(spark, d, "v_coarse_chunk"), view(spark, d, "v_vec_mention"),
                             view(spark, d, "v_vec_relation"), view(spark, d, "v_rerank_score"), SETTINGS)


@register("a15_context_texts", f"""WITH {MERGED} SELECT m.query_id, string_agg(c.title_hierarchy || ' ' || m.chunk_id, chr(10) || '---' || chr(10) ORDER BY score DESC, m.chunk_id) AS joined
  FROM merged m JOIN v_chunk_vec c ON c.chunk_id = m.chunk_id GROUP BY 1""", VEC)
def a15(spark, d):
    chunks, queries, _ = _vec(spark, d)
    m = R.merge_variants(R.vector_recall(chunks, queries), chunks).join(chunks.select("chunk_id", "title_hierarchy"), "chunk_id")
    m = m.select("query_id", (-F.col("score")).alias("o"), "chunk_id", F.concat_ws(" ", "title_hierarchy", "chunk_id").alias("text"))
    return R.joined(m, ["o", "chunk_id"], "text", "\n---\n", "joined")


@register("vector_centroid", """SELECT label, round(sqrt(sum(m * m)), 6) AS norm FROM (SELECT label, i, avg(x) AS m FROM (
  SELECT label, cast(unnest(embedding) AS double) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e GROUP BY 1, 2) t GROUP BY 1""")
def centroids(spark, d):
    c = R.centroid(read_table(spark, d, "embeddings"), ["label"])
    return c.select("label", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))
