"""Windowed stream aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators import ordered


def as_event_time(df: DataFrame, ts: str = "create_time") -> DataFrame:
    """Zone-less event times become timestamps, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def sliding_digest(questions: DataFrame, size: str = "24 hours", slide: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Count and last time per question and sliding window; closed windows only."""
    return (as_event_time(questions).withWatermark("create_time", delay)
            .groupBy(F.window("create_time", size, slide).alias("w"), "question")
            .agg(F.count(F.lit(1)).alias("cnt"), F.max("create_time").alias("last_time"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "question", "cnt", "last_time"))


def activity_sessions(events: DataFrame, ttl: str = "2 hours", delay: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Activity per user of a stream; every use pushes the expiry out, closed sessions only."""
    return (as_event_time(events, ts).withWatermark(ts, delay)
            .groupBy(F.session_window(ts, ttl).alias("w"), user).agg(F.count(F.lit(1)).alias("uses"))
            .select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "uses"))


def activity_sessions_batch(events: DataFrame, ttl: str = "2 hours", user: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The same over a finished table: gaps are found and numbered in pieces, so no user's events meet in one task."""
    expiry = F.expr(f"INTERVAL {ttl}")
    rows = as_event_time(events, ts).select(user, F.col(ts).alias("t"), F.col(ts).alias("at"), F.col(order).alias("o"))
    hot = ordered.hot_keys(rows, [user], ["at", "o"])
    rows = ordered.neighbours(rows, [user], ["at", "o"], "t", prev="before", hot=hot)
    starts = F.when(F.col("before").isNull() | (F.col("at") > F.col("before") + expiry), 1).otherwise(0).cast("bigint")
    rows = ordered.running_sum(rows, [user], ["at", "o"], {"session_no": starts}, hot=hot)
    return (rows.groupBy(user, "session_no").agg(F.min("at").alias("session_start"), (F.max("at") + expiry).alias("session_end"),
                                                 F.count(F.lit(1)).alias("uses")).drop("session_no"))


def daily_buckets(questions: DataFrame, delay: str = "1 hour") -> DataFrame:
    return (as_event_time(questions).withWatermark("create_time", delay)
            .groupBy(F.window("create_time", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.col("w.start").alias("day"), "cnt"))
