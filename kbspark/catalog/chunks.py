"""Text normalisation and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.catalog import register
from kbspark.functions import scalars as C
from kbspark.functions import text as X
from kbspark.operators import chunking as K
from kbspark.operators.layout import spread
from kbspark.session import cut_lineage
from kbspark.sources.fixtures import view
from kbspark.sources.tables import read_table

LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@register("r7_text_to_markdown", f"SELECT doc_id, array_to_string(list_transform({LINES}, lambda x: x || chr(10) || chr(10)), '') AS markdown FROM documents")
def r7(spark, d):
    return read_table(spark, d, "documents").select("doc_id", X.text_to_markdown("text").alias("markdown"))


@register("r8_promote_headings", f"""SELECT doc_id, array_to_string(list_transform({LINES}, lambda x: CASE WHEN length(x) < 100 AND NOT contains(x, '.') AND regexp_matches(x, '[A-Z]')
  THEN '## ' ELSE '' END || x || chr(10) || chr(10)), '') AS markdown FROM documents""")
def r8(spark, d):
    return read_table(spark, d, "documents").select("doc_id", X.promote_headings("text").alias("markdown"))


@register("r12_page_markers", r"""WITH t AS (SELECT conv_id, string_agg('[[PAGE:' || cast(turn AS string) || ']]' || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10), ''
    ORDER BY turn) AS text FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1)
  SELECT conv_id, text, regexp_replace(regexp_replace(text, '\[\[PAGE:\d+\]\]\s*', '', 'g'), '^\s+|\s+$', '', 'g') AS stripped FROM t""")
def r12(spark, d):
    t = X.with_page_markers(read_table(spark, d, "conversations"), "conv_id", "turn", "text")
    return t.select("conv_id", "text", C.strip_page_markers("text").alias("stripped"))


@register("a13_page_range", r"""SELECT doc_code, CASE WHEN len(p) = 0 THEN '1' WHEN p[1] = p[-1] THEN p[1] ELSE p[1] || '-' || p[-1] END AS page_range
  FROM (SELECT doc_code, regexp_extract_all(text, '\[\[PAGE:(\d+)\]\]', 1) AS p FROM v_structured_doc) t""", "v_structured_doc")
def a13(spark, d):
    return view(spark, d, "v_structured_doc").select("doc_code", C.page_range("text").alias("page_range"))


EDGE = r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'"
# Heading levels 1 to 3 occur in the structured documents.
SECTIONS = rf"""lns AS (SELECT doc_code, i, l, CASE WHEN regexp_matches(l, '\[\[PAGE:\d+\]\]') THEN 0 ELSE length(regexp_extract(regexp_replace(l, {EDGE}), '^(#{{1,6}})\s+(.+)$', 1)) END AS level,
    regexp_replace(regexp_extract(regexp_replace(l, {EDGE}), '^(#{{1,6}})\s+(.+)$', 2), {EDGE}) AS title
    FROM (SELECT doc_code, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {{src}}) t),
  sec AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_code ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM lns),
  heads AS (SELECT doc_code, s, level, title,
    last_value(CASE WHEN level <= 1 THEN struct_pack(lv := level, tt := title) END IGNORE NULLS) OVER w AS l1,
    last_value(CASE WHEN level <= 2 THEN struct_pack(lv := level, tt := title) END IGNORE NULLS) OVER w AS l2
    FROM sec WHERE level > 0 WINDOW w AS (PARTITION BY doc_code ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  bodies AS (SELECT doc_code, s, regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i), ''), {EDGE}) AS content FROM sec WHERE level = 0 GROUP BY 1, 2),
  parsed AS (SELECT b.doc_code, cast(row_number() OVER (PARTITION BY b.doc_code ORDER BY b.s) - 1 AS int) AS section_no, content,
    CASE WHEN h.s IS NULL THEN [] WHEN h.level = 1 THEN [h.title]
      WHEN h.level = 2 THEN [CASE WHEN h.l1.lv = 1 THEN h.l1.tt ELSE '' END, h.title]
      ELSE [CASE WHEN h.l1.lv = 1 THEN h.l1.tt ELSE '' END, CASE WHEN h.l2.lv = 2 THEN h.l2.tt ELSE '' END, h.title] END AS hierarchy
    FROM bodies b LEFT JOIN heads h ON h.doc_code = b.doc_code AND h.s = b.s WHERE content <> ''),
  sections AS (SELECT doc_code, section_no, content, hierarchy FROM parsed UNION ALL
    SELECT doc_code, 0, regexp_replace(text, {EDGE}), cast([] AS varchar[]) FROM {{src}} WHERE doc_code NOT IN (SELECT doc_code FROM parsed))"""


@register("r9_sections", f"WITH {SECTIONS.replace('{src}', 'v_structured_doc')} SELECT doc_code, section_no, array_to_string(hierarchy, ' > ') AS hierarchy, content FROM sections", "v_structured_doc")
def r9(spark, d):
    return (K.section_rows(spread(view(spark, d, "v_structured_doc")))
            .select("doc_code", "section_no", F.array_join("hierarchy", " > ").alias("hierarchy"), "content"))


TOKENS = r"""len(regexp_extract_all({t}, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}]|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]'))"""


UNIT = r"(?s).*?(?:" + TOKENS[TOKENS.index("'") + 1:TOKENS.rindex("'")].replace("{{", "{").replace("}}", "}") + ")"


def split_sql(name: str, src: str, terms: str) -> str:
    """Recursive form of the boundary split over rows (k, text, target, overlap, maximum): ranges of tokens, with each token's end and the last sentence end so far as lists."""
    to = "least(first + maximum, n)"
    cut = f"CASE WHEN n - first <= target THEN n WHEN ls[{to}] >= first + target THEN ls[{to}] ELSE {to} END"
    return rf"""{name}_u AS (SELECT k, unnest(u) AS u, generate_subscripts(u, 1) AS i FROM (SELECT k, regexp_extract_all(text, '{UNIT}') AS u FROM {src}) t),
  {name}_w AS (SELECT k, i, sum(length(u)) OVER w AS e, max(CASE WHEN regexp_matches(right(u, 1), '[{terms}]') THEN i ELSE 0 END) OVER w AS l FROM {name}_u WINDOW w AS (PARTITION BY k ORDER BY i)),
  {name}_l AS (SELECT k, list(cast(e AS bigint) ORDER BY i) AS es, list(cast(l AS bigint) ORDER BY i) AS ls FROM {name}_w GROUP BY k),
  {name}_in AS (SELECT s.k, text, greatest(target, 1) AS target, greatest(overlap, 0) AS overlap, greatest(maximum, target, 1) AS maximum, coalesce(len(es), 0) AS n, es, ls
    FROM {src} s LEFT JOIN {name}_l l ON s.k = l.k WHERE regexp_matches(text, '\S')),
  {name}_run AS (SELECT k, cast(1 AS bigint) AS m, cast(0 AS bigint) AS first, cast({cut} AS bigint) AS last FROM (SELECT *, 0 AS first FROM {name}_in) t
    UNION ALL SELECT k, m, first, cast({cut} AS bigint) FROM (SELECT i.*, m + 1 AS m, greatest(last - overlap, first + 1) AS first FROM {name}_run r JOIN {name}_in i ON r.k = i.k WHERE last < n) t),
  {name} AS (SELECT k, m AS n, piece FROM (SELECT r.k, m, regexp_replace(substring(text, (CASE WHEN first = 0 THEN 0 ELSE es[first] END) + 1,
    (CASE WHEN last = n THEN length(text) ELSE es[last] END) - (CASE WHEN first = 0 THEN 0 ELSE es[first] END)), {EDGE}) AS piece FROM {name}_run r JOIN {name}_in i ON r.k = i.k) t WHERE piece <> '')"""


@register("r10_boundary_split", f"""WITH RECURSIVE asked AS (SELECT doc_id AS k, text, 120 AS target, 30 AS overlap, 160 AS maximum FROM documents), {split_sql('cuts', 'asked', '。！？；!?;')}
  SELECT k AS doc_id, cast(row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS int) AS piece_no, piece FROM cuts""")
def r10(spark, d):
    docs = spread(read_table(spark, d, "documents"))
    return docs.select("doc_id", F.posexplode(K.splitter(120, 30, 160)("text")).alias("piece_no", "piece"))


STRUCTURED = "。！？；!?;."
PREFIX = "CASE WHEN array_to_string(list_filter(hierarchy, lambda h: trim(h) <> ''), ' > ') = '' THEN '' ELSE '[' || array_to_string(list_filter(hierarchy, lambda h: trim(h) <> ''), ' > ') || ']' || chr(10) || chr(10) END"
STRIP = r"regexp_replace(regexp_replace({c}, '\[\[PAGE:\d+\]\]\s*', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
PAGES = r"regexp_extract_all({c}, '\[\[PAGE:(\d+)\]\]', 1)"

def chunked_sql(src: str, terms: str) -> str:
    """Two-level chunks of a (doc_code, text) relation."""
    return rf"""{SECTIONS.replace('{src}', src)},
  pre AS (SELECT *, {PREFIX} AS prefix FROM sections),
  sized AS (SELECT *, {TOKENS.format(t='prefix')} AS pt FROM pre),
  c_in AS (SELECT doc_code || '|' || cast(section_no AS string) AS k, content AS text, 1280 - pt AS target, cast(floor((1280 - pt) * cast(0.2 AS double)) AS bigint) AS overlap, 1536 - pt AS maximum FROM sized),
  {split_sql('c_cut', 'c_in', terms)},
  coarse AS (SELECT s.doc_code, s.section_no, s.prefix, s.pt, row_number() OVER (PARTITION BY s.doc_code ORDER BY s.section_no, c.n) - 1 AS ord, c.piece
    FROM c_cut c JOIN sized s ON s.doc_code || '|' || cast(s.section_no AS string) = c.k),
  f_in AS (SELECT doc_code || '|' || cast(ord AS string) AS k, piece AS text, 448 - pt AS target, cast(floor((448 - pt) * cast(0.25 AS double)) AS bigint) AS overlap, 512 - pt AS maximum FROM coarse),
  {split_sql('f_cut', 'f_in', terms)},
  fine AS (SELECT s.doc_code, s.section_no, s.prefix, s.ord AS parent_ord, row_number() OVER (PARTITION BY s.doc_code ORDER BY s.ord, f.n) - 1 AS ord, f.piece
    FROM f_cut f JOIN coarse s ON s.doc_code || '|' || cast(s.ord AS string) = f.k),
  every AS (SELECT doc_code, section_no, prefix, 'COARSE' AS chunk_type, cast(NULL AS bigint) AS parent_ord, ord, piece FROM coarse
    UNION ALL SELECT doc_code, section_no, prefix, 'FINE', parent_ord, ord, piece FROM fine),
  chunks AS (SELECT doc_code, section_no, chunk_type, ord, sha256(doc_code || '|' || chunk_type || '|' || cast(ord AS string)) AS chunk_id,
    sha256(doc_code || '|COARSE|' || cast(parent_ord AS string)) AS parent_chunk_id, prefix || {STRIP.format(c='piece')} AS content, {PAGES.format(c='piece')} AS p FROM every)"""


CHUNKED = chunked_sql('v_structured_doc', STRUCTURED)


def _chunks(spark, d, keep=()):
    return K.chunk_documents(spread(view(spark, d, "v_structured_doc")), terminators=STRUCTURED, keep=keep)


@register("r11_two_level_chunks", f"""WITH RECURSIVE {CHUNKED}
  SELECT doc_code, section_no, chunk_type, cast(CASE WHEN chunk_type = 'FINE' THEN ord ELSE -1 END AS int) AS chunk_index, chunk_id, parent_chunk_id,
    lag(chunk_id) OVER (PARTITION BY doc_code, chunk_type ORDER BY ord) AS prev_chunk_id, lead(chunk_id) OVER (PARTITION BY doc_code, chunk_type ORDER BY ord) AS next_chunk_id,
    content, CASE WHEN len(p) = 0 THEN '1' WHEN p[1] = p[-1] THEN p[1] ELSE p[1] || '-' || p[-1] END AS page_number, cast({TOKENS.format(t='content')} AS int) AS token_size FROM chunks""", "v_structured_doc")
def r11(spark, d):
    return _chunks(spark, d).select("doc_code", "section_no", "chunk_type", "chunk_index", "chunk_id", "parent_chunk_id", "prev_chunk_id",
                                    "next_chunk_id", "content", "page_number", "token_size")


@register("r11_chunk_sizes", f"""WITH RECURSIVE {CHUNKED}, t AS (SELECT chunk_type, {TOKENS.format(t='content')} AS n FROM chunks)
  SELECT chunk_type, count(*) AS chunks, cast(sum(n) AS bigint) AS tokens, count(*) FILTER (n > CASE WHEN chunk_type = 'FINE' THEN 512 ELSE 1536 END) AS oversize FROM t GROUP BY 1""", "v_structured_doc")
def r11_sizes(spark, d):
    """Chunk counts, tokens and chunks above their maximum, per level."""
    top = F.when(F.col("chunk_type") == "FINE", K.FINE.maximum).otherwise(K.COARSE.maximum)
    return _chunks(spark, d).groupBy("chunk_type").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_size").alias("tokens"), F.count_if(F.col("token_size") > top).alias("oversize"))


@register("q9_carried_pages", f"""WITH RECURSIVE {CHUNKED}, f AS (SELECT doc_code, ord, p, last_value(CASE WHEN len(p) > 0 THEN p[-1] END IGNORE NULLS) OVER
    (PARTITION BY doc_code ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM chunks WHERE chunk_type = 'FINE')
  SELECT doc_code, cast(ord AS int) AS chunk_index, CASE WHEN len(p) = 0 THEN coalesce(carried, '1') WHEN p[1] = p[-1] THEN p[1] ELSE p[1] || '-' || p[-1] END AS page_number FROM f""", "v_structured_doc")
def carried(spark, d):
    stored = cut_lineage(_chunks(spark, d).select("doc_code", "chunk_type", "chunk_index", "page_number", "last_page"))
    return K.carry_pages(stored).select("doc_code", "chunk_index", "page_number")


@register("chunk_text_udtf", f"""WITH RECURSIVE asked AS (SELECT doc_id AS k, text, 200 AS target, 50 AS overlap, 256 AS maximum FROM documents), {split_sql('cuts', 'asked', '。！？；!?;')}
  SELECT k AS doc_id, cast(row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS int) AS piece_no, piece FROM cuts""")
def udtf_pieces(spark, d):
    from kbspark.functions.udtf import register_chunk_text

    register_chunk_text(spark)
    return spark.sql("SELECT d.doc_id, c.piece_no, c.piece FROM {docs} d, LATERAL chunk_text(d.text, 200, 50, 256) c",
                     docs=spread(read_table(spark, d, "documents")))
