"""Questions to answer contexts as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import rewrite_queries, topic_words, with_query_variants
from kbspark.operators import graph, retrieval


@dataclass(frozen=True)
class RetrievalSettings:
    """Limits and thresholds of one retrieval run."""

    recall_k: int = 20
    min_score: float = 0.0
    top_k: int = 5
    threshold: float = 0.85
    floor: float = 0.85
    external_threshold: float = 0.85
    hop_rows: int = 30
    graph_chars: int | None = None
    keep: str = "first"
    scale: str = "unit"
    scope: str = "strict"


def question_vectors(questions: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Query vectors of the rewritten variants by a caller's embedding step.

    ``embed`` receives query_id, query_pos, query_text, tenant_code and
    system_type and adds ``embedding``.
    """
    return embed(rewrite_queries(questions.select("query_id", "tenant_code", "system_type", "question")))


def candidates(questions: DataFrame, query_vectors: DataFrame, chunks: DataFrame, s: RetrievalSettings) -> DataFrame:
    """Recalled chunks of each question with scores, texts and topics."""
    hits = retrieval.vector_recall(chunks, query_vectors, s.recall_k, s.min_score, s.scale, s.scope)
    merged = retrieval.merge_variants(hits, chunks, s.keep)
    q = with_query_variants(questions).select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("tenant_code"),
        topic_words(F.array_join("variants", " ")).alias("query_topics"))
    c = chunks.select("chunk_id", F.col("tenant_code").alias("doc_tenant"), "content", "parent_chunk_id")
    return (merged.select("query_id", "chunk_id", "doc_code", "chunk_index", "query_pos", "score")
            .join(c, "chunk_id").join(q, "query_id").withColumn("doc_topics", topic_words("content")))


def ranked_hits(questions: DataFrame, query_vectors: DataFrame, chunks: DataFrame, scores: DataFrame | None,
                s: RetrievalSettings) -> DataFrame:
    found = candidates(questions, query_vectors, chunks, s)
    return retrieval.rerank(found, scores, s.top_k, s.threshold, s.floor, s.external_threshold)


def answer_contexts(questions: DataFrame, query_vectors: DataFrame, chunks: DataFrame, coarse: DataFrame, mentions: DataFrame,
                    relations: DataFrame, scores: DataFrame | None = None,
                    s: RetrievalSettings = RetrievalSettings()) -> DataFrame:
    """One row per question with any hit: its context text and the source of the ranking.

    The ranked hits are few per question; they are checkpointed once because
    the fine, parent, graph and source branches all start from them.
    """
    from kbspark.session import cut_lineage

    top = cut_lineage(ranked_hits(questions, query_vectors, chunks, scores, s))
    hits = top.join(chunks.select("chunk_id", "content", "parent_chunk_id", "doc_code"), "chunk_id")
    fine = retrieval.joined(hits, ["position"], "content", "\n---\n", "vector_context")
    parents = retrieval.joined(retrieval.parent_contents(hits, coarse), ["chunk_id"], "content", "\n---\n", "coarse_context")
    q = questions.select(F.col("query_id").cast("bigint").alias("query_id"), "tenant_code", "system_type")
    paths = graph.multi_hop(top.select("query_id", "chunk_id").join(q, "query_id"), chunks, mentions, relations, s.hop_rows)
    ctx = retrieval.assemble_context(q, fine, parents, retrieval.graph_context(paths, s.graph_chars))
    per_q = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.max("source").alias("rank_source"))
    return ctx.join(per_q, "query_id")
