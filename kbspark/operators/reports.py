"""Unanswered-question and document reports (A7-A9, A14, S8, S9, U3, X8 batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.predicates import in_time_range, parse_id_list


def unanswered_stats(questions: DataFrame, start: str | Column | None = None, end: str | Column | None = None,
                     tenant: str | None = None) -> DataFrame:
    """Count and last time per question."""
    if start is not None and end is not None:
        questions = questions.filter(in_time_range(start, end, tenant))
    elif tenant:
        questions = questions.filter(F.col("tenant_code") == tenant)
    return questions.groupBy("question").agg(F.count(F.lit(1)).alias("cnt"), F.max("create_time").alias("last_time"))


def by_count(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.col("cnt").desc(), F.col("last_time").desc(), F.col("question").asc())


def stats_envelope(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("question_count"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def digest(questions: DataFrame, as_of: Column, hours: int = 24, top: int = 20) -> DataFrame:
    """Top questions of the last hours with the distinct and total counts of the window."""
    stats = unanswered_stats(questions.filter((F.col("create_time") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
                                              & (F.col("create_time") < as_of)))
    env = stats_envelope(stats)
    return (by_count(stats).limit(top)
            .withColumns({"question_count": env.select("question_count").scalar(), "total": env.select("total").scalar()}))


def document_stats(documents: DataFrame, tenant: str | None = None) -> DataFrame:
    """Finished documents and their chunks; no tenant or '0' counts all."""
    ok = documents.filter(F.col("status") == "SUCCESS")
    if tenant and tenant != "0":
        ok = ok.filter(F.col("tenant_code") == tenant)
    return ok.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_total"))


def document_stats_by_tenant(documents: DataFrame) -> DataFrame:
    """The same for every tenant and the grand total (tenant null) in one pass."""
    return (documents.filter(F.col("status") == "SUCCESS").rollup("tenant_code")
            .agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_total")))


def tenant_list(tenants: DataFrame, all_name: str = "All tenants") -> DataFrame:
    """The reserved tenant '0' ahead of the enabled tenants by id."""
    spark = tenants.sparkSession
    first = spark.range(1).select(F.lit(None).cast("bigint").alias("id"), F.lit("0").alias("tenant_code"),
                                  F.lit(all_name).alias("tenant_name"), F.lit(True).alias("enabled"))
    rest = tenants.filter("enabled").select("id", "tenant_code", "tenant_name", "enabled")
    return first.unionByName(rest).orderBy(F.col("id").asc_nulls_first())


def export_rows(questions: DataFrame, start: Column | str | None = None, end: Column | str | None = None,
                tenant: str | None = None, ids: Column | None = None) -> DataFrame:
    """Export projection: the listed ids when given, else the time range."""
    cond = F.array_contains(parse_id_list(ids), F.col("id")) if ids is not None else in_time_range(start, end, tenant)
    return questions.filter(cond).select("id", "question", "answer")


def daily_counts(questions: DataFrame) -> DataFrame:
    return (questions.groupBy(F.window(F.col("create_time").cast("timestamp"), "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.col("w.start").alias("day"), "cnt"))


def monthly_counts(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_format(F.trunc("day", "MM"), "yyyy-MM").alias("month")).agg(F.sum("cnt").alias("cnt"))
