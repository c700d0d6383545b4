"""One query for each operator, over its whole table with production parameters, and check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.llm import decontaminate, fingerprint, jaccard, language, mixing, nra, periodic, rtree, shards, templates, tokens, toxicity, warc
from kbspark.sources.tables import read_table

#: Path of the tokenizer model; a parameter of the operator.
MODEL = "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~C.held_out()))
    rows = docs.select("doc_id", C.held_out().alias("held_out"), "text")
    return language.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "lang_spans")


def op2_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.with_next(read_table(spark, d, "documents"))


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read_table(spark, d, "documents").select("doc_id", "text"), read_table(spark, d, "labels")
    seen = labels.filter(~C.held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    # the join only carries a bounded sample of labels, chosen by id; fit() takes all rows that it gets
    share = min(1.0, 20_000 / max(seen.count(), 1))
    chosen = seen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    model = toxicity.fit(docs.join(F.broadcast(chosen), "doc_id"), max_rows=25_000)
    rows = docs.select("doc_id", C.held_out().alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, d, "documents"), public_tokenizers.path(MODEL)).withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_copies(read_table(spark, d, "documents"))


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    path = C.scratch_path(spark, "warc")
    warc.write_archive(read_table(spark, d, "pages"), path)
    got = warc.read_archive(spark, path)
    # the archive was written just now: a gap in it is an error, not a page less
    got = got.filter(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", "file", "offset", "problem")).cast("boolean")))
    return got.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("refers_to"))


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY s) END AS least FROM q)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to FROM f"""


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return templates.drop_recurring_lines(read_table(spark, d, "documents").select("doc_id", "text"), short_lines=True)


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shards.shard(rows, text="text_crc32").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, d, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    words = read_table(spark, d, "documents").select("doc_id", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({C.WORD})")).alias("words"))
    # a tenth of the texts, by a checksum of their id, repeats its first p words from word a on
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = (words.select("doc_id", "text", "words", F.size("words").alias("n"), h.alias("h"), F.expr("crc32(CAST(CAST(doc_id AS string) AS binary)) div 10").alias("g"))
            .withColumn("a", F.expr("CAST(pmod(g, greatest(n, 1)) AS int)")).withColumn("p", F.expr("CAST(1 + ((n - a) div (3 + g % 8)) AS int)")))
    again = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), CAST(((n - a) div p) AS int) + 1)), 1, n - a)), ' ')")
    rows = rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic_runs(rows)
    # least of (-length, start, period): the longest run, then the first, then the smallest period
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS minus, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", (-F.col("best.minus")).alias("length"), "best.period",
                    F.expr("(-1000 * best.minus) div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op12_topk_inner_product(spark: SparkSession, d: str) -> DataFrame:
    return nra.top_k(read_table(spark, d, "embeddings"), F.col("id") % 50 == 0, 5)


VECTORS = """
WITH v AS (SELECT vec_id, label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""
OP12 = VECTORS + """,
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(read_table(spark, d, "embeddings"), F.col("id") % 50 == 0, label)


OP13 = VECTORS + """,
w AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_fingerprints, op3_toxicity, op4_token_counts, op5_jaccard_join, op6_warc, op7_line_dedup, op8_sharding,
    op9_benchmark_decontamination, op10_mixing, op11_periodic_runs, op12_topk_inner_product, op13_hard_negatives)}
CHECKS: dict[str, str] = {"op6_warc": OP6, "op12_topk_inner_product": OP12, "op13_hard_negatives": OP13}
