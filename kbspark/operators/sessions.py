"""Conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators import ordered


def _newest(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.col("create_time").desc(), F.col("id").desc())


def latest_messages(messages: DataFrame) -> DataFrame:
    """Newest message per session; the rank limit is applied before the shuffle."""
    return (messages.withColumn("__rn", F.row_number().over(_newest("session_id")))
            .filter(F.col("__rn") == 1).drop("__rn"))


def recent_messages(messages: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (messages.withColumn("rn", F.row_number().over(_newest("session_id")))
            .filter((F.col("rn") <= offset + n) & (F.col("rn") > offset)))


def oldest_messages(messages: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("create_time", "id")
    return messages.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def user_conversations(messages: DataFrame, user: str, tenant: str, system: str) -> DataFrame:
    cond = (F.col("user_id") == user) & (F.col("tenant_code") == tenant) & (F.col("system_type") == system)
    return messages.filter(cond).orderBy(F.col("create_time").desc(), F.col("id").desc())


def session_messages_of_key(messages: DataFrame, session_id: str, api_key_id: int) -> DataFrame:
    return (messages.filter((F.col("session_id") == session_id) & (F.col("api_key_id") == api_key_id))
            .orderBy("create_time", "id"))


def cumulative_to_delta(fragments: DataFrame) -> DataFrame:
    """Only the new suffix of each cumulative text, and only where it grew."""
    df = ordered.neighbours(fragments, ["session_id"], ["seq"], "text", prev="__prev")
    done = F.length(F.coalesce("__prev", F.lit("")))
    return (df.filter(F.length("text") > done)
            .select("session_id", "seq", F.col("text").substr(done + 1, F.length("text") - done).alias("delta")))


def inherit_titles(messages: DataFrame) -> DataFrame:
    """Each message takes the newest earlier non-empty title of its session, '' when there is none."""
    df = ordered.carry_last(messages, ["session_id"], ["create_time", "id"],
                            F.nullif(F.col("title"), F.lit("")), "__t", inclusive=False)
    return df.withColumn("inherited_title", F.coalesce("__t", F.lit(""))).drop("__t")


def exchange_text(question: Column, answer: Column, labels: tuple[str, str] = ("User", "Assistant")) -> Column:
    return F.concat(F.lit(f"{labels[0]}: "), question, F.lit(f"\n{labels[1]}: "), F.coalesce(answer, F.lit("")))


def history_context(messages: DataFrame, summaries: DataFrame, keep: int = 10) -> DataFrame:
    """Per session: the newest ``keep`` exchanges as text, counts, and whether a new summary is due."""
    recent = recent_messages(messages, keep)
    piece = F.struct(F.col("create_time"), F.col("id"), exchange_text(F.col("question"), F.col("answer")).alias("t"))
    recent = recent.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "\n\n").alias("recent_text"))
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_count"))
    blank = F.coalesce(F.trim("summary"), F.lit("")) == ""
    long_one = F.col("total_count") > keep
    due = long_one & (blank | (F.col("total_count") - F.coalesce("last_message_count", F.lit(0)) >= keep))
    head = F.concat(F.lit("[Earlier summary]\n"), F.col("summary"), F.lit("\n\n[Recent exchanges]\n"))
    return (counts.join(recent, "session_id").join(summaries, "session_id", "left")
            .select("session_id", "total_count", F.greatest(F.col("total_count") - keep, F.lit(0)).alias("older_count"),
                    due.alias("needs_summary"),
                    F.when(long_one & ~blank, F.concat(head, "recent_text")).otherwise(F.col("recent_text")).alias("context")))


def older_messages(messages: DataFrame, keep: int = 10) -> DataFrame:
    """Messages before the newest ``keep`` of their session, one row each."""
    cut = (recent_messages(messages, 1, keep - 1)
           .select("session_id", F.struct("create_time", "id").alias("__cut")))
    return (messages.join(cut, "session_id")
            .filter(F.struct("create_time", "id") < F.col("__cut")).select(*messages.columns))


def messages_per_session(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))


def save_conversation(messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append the new exchanges, then the session table: first values kept, title and time of the last."""
    new = new.filter(F.coalesce("question", F.lit("")) != "").withColumn("answer", F.coalesce("answer", F.lit("")))
    every = messages.unionByName(new, allowMissingColumns=True)
    return every, upsert_sessions(every)


def upsert_sessions(messages: DataFrame) -> DataFrame:
    when = F.struct("create_time", "id")
    return messages.groupBy("session_id").agg(
        F.min_by("user_id", when).alias("user_id"), F.min_by("api_key_id", when).alias("api_key_id"),
        F.min_by("tenant_code", when).alias("tenant_code"), F.min_by("system_type", when).alias("system_type"),
        F.max_by("title", when).alias("title"), F.min("create_time").alias("create_time"),
        F.max("create_time").alias("update_time"))


def missing_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session rows to insert: newest message of each session the table does not hold."""
    new = latest_messages(messages.join(sessions.select("session_id"), "session_id", "left_anti"))
    return new.select("session_id", "user_id", "title", "api_key_id", "tenant_code", "system_type",
                      F.col("create_time"), F.col("create_time").alias("update_time"))


def delete_sessions(targets: DataFrame, messages: DataFrame, summaries: DataFrame, sessions: DataFrame,
                    owned: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove the target sessions from three tables.

    With ``owned`` the targets carry api_key_id, and only sessions that hold a
    message of that key are removed.
    """
    if owned:
        targets = targets.join(messages.select("session_id", "api_key_id"), ["session_id", "api_key_id"], "left_semi")
    gone = targets.select("session_id").distinct()
    return tuple(t.join(gone, "session_id", "left_anti") for t in (messages, summaries, sessions))


def update_titles(updates: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Set the new title on every row of the session in each table."""
    new = updates.select("session_id", F.col("title").alias("__title"))
    return tuple(t.join(new, "session_id", "left").withColumn("title", F.coalesce("__title", "title")).select(*t.columns)
                 for t in tables)
