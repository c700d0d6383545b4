"""Uploads to stored chunks and document status rows (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.scalars import file_type
from kbspark.functions.text import promote_headings, text_to_markdown
from kbspark.operators.chunking import chunk_documents
from kbspark.operators.layout import spread
from kbspark.operators.maintenance import admission_reason
from kbspark.sources import sinks

NO_TEXT = "no text content"


def normalised(uploads: DataFrame) -> DataFrame:
    """Markdown text per upload: Markdown as it is, office text with promoted headings, other text line by line."""
    kind = file_type("file_name")
    text = (F.when(kind == "MARKDOWN", F.col("content")).when(kind == "WORD", promote_headings("content"))
            .otherwise(text_to_markdown("content")))
    return uploads.withColumn("text", text)


def admitted(uploads: DataFrame, max_size: int) -> DataFrame:
    """Uploads with their Markdown text and ``reason``, null where the upload may be chunked."""
    with_reason = normalised(uploads).withColumn("reason", admission_reason("file_name", "file_size", max_size))
    has_text = F.coalesce(F.col("content").rlike(r"\S"), F.lit(False))
    return with_reason.withColumn("reason", F.coalesce("reason", F.when(~has_text, NO_TEXT)))


def ingest_chunks(uploads: DataFrame, max_size: int = 50 << 20, **chunking) -> DataFrame:
    """Chunk rows of the uploads that pass."""
    ok = admitted(spread(uploads), max_size).filter(F.col("reason").isNull())
    return (chunk_documents(ok, keep=("tenant_code", "system_type", "file_name"), **chunking)
            .withColumns({"enabled": F.lit(True), "status": F.lit("SUCCESS")}).drop("last_page"))


def ingest_status(uploads: DataFrame, chunks: DataFrame, max_size: int = 50 << 20) -> DataFrame:
    """One status row per upload: SUCCESS with its fine-chunk count, or FAILED with the reason."""
    counts = chunks.filter("chunk_type = 'FINE'").groupBy("doc_code").agg(F.count(F.lit(1)).alias("n"))
    reason = F.coalesce(F.col("reason"), F.when(F.col("n").isNull(), "no fine chunk"))
    return (admitted(uploads, max_size).select("doc_code", "reason").join(counts, "doc_code", "left")
            .select("doc_code", F.when(reason.isNull(), "SUCCESS").otherwise("FAILED").alias("status"), reason.alias("error_message"),
                    F.coalesce("n", F.lit(0)).alias("chunk_count"), reason.isNull().alias("enabled")))


def run_ingest(uploads: DataFrame, chunk_path: str, status_path: str, max_size: int = 50 << 20, **chunking) -> None:
    """Write chunks, then the status rows counted from what was written.

    Both folders belong to this run; a repeated run overwrites them.
    """
    spark = uploads.sparkSession
    sinks.write_chunks(ingest_chunks(uploads, max_size, **chunking), chunk_path, "overwrite")
    ingest_status(uploads, sinks.read_chunks(spark, chunk_path), max_size).write.mode("overwrite").parquet(status_path)
