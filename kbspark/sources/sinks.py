"""Chunk store, CSV and Markdown sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kbspark.operators import ordered
from kbspark.operators.maintenance import SOURCES_SCHEMA
from kbspark.session import cut_lineage
from kbspark.sources import files


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "content",
          out: str = "embedding", batch: int = 16) -> DataFrame:
    """Vectors from any callable, called with at most ``batch`` texts at a time."""
    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i:i + batch])]
            yield pd.Series(vectors)

    return chunks.withColumn(out, run(F.col(text)))


def write_chunks(chunks: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by tenant and system, so that visibility prunes folders.

    The rebalance hint gathers each folder's rows and lets adaptive execution
    cut a dominant tenant into tasks of the advisory size.
    """
    (chunks.hint("rebalance", F.col("tenant_code"), F.col("system_type"))
     .write.mode(mode).partitionBy("tenant_code", "system_type").parquet(path))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("basePath", path).parquet(path)
            .withColumns({"tenant_code": F.col("tenant_code").cast("string"), "system_type": F.col("system_type").cast("string")}))


def write_csv(df: DataFrame, path: str) -> None:
    """Header line, every field quoted, quotes doubled, UTF-8."""
    df.write.option("header", "true").option("quoteAll", "true").option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path))


def conversation_markdown(messages: DataFrame, labels: tuple[str, str] = ("User", "Assistant")) -> DataFrame:
    """One Markdown piece per message with its numbered sources."""
    src = F.from_json("sources", SOURCES_SCHEMA)
    numbered = F.transform(src, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["docCode"]))
    cites = F.when(F.size(src) > 0, F.concat(F.lit("\n\n"), F.array_join(numbered, "\n"))).otherwise("")
    return messages.select("session_id", "create_time", "id", F.concat(
        F.lit(f"**{labels[0]}:** "), F.col("question"), F.lit(f"\n\n**{labels[1]}:** "), F.coalesce("answer", F.lit("")),
        cites).alias("markdown"))


def conversation_parts(messages: DataFrame, per_part: int = 200, labels: tuple[str, str] = ("User", "Assistant")) -> DataFrame:
    """(session_id, part, messages, first_id, last_id, markdown): consecutive messages of a session, ``per_part`` to a part, joined by rules.

    Messages are numbered by the ordered helpers, so a long session is cut without going through one task, and a part is all that is gathered.
    """
    rows = ordered.row_numbers(conversation_markdown(messages, labels), ["session_id"], ["create_time", "id"], "n")
    piece = F.struct("n", "id", F.col("markdown").alias("t"))
    parts = rows.groupBy("session_id", F.floor((F.col("n") - 1) / per_part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(piece)).alias("a"))
    return parts.select("session_id", "part", F.size("a").alias("messages"), F.element_at("a", 1)["id"].alias("first_id"), F.element_at("a", -1)["id"].alias("last_id"),
                        F.array_join(F.transform("a", lambda x: x["t"]), "\n\n---\n\n").alias("markdown"))


def write_conversations(messages: DataFrame, path: str, per_part: int = 200, folders: int = 64, labels: tuple[str, str] = ("User", "Assistant")) -> None:
    """Conversations as Markdown below ``path/pages`` in a fixed number of folders, chosen by a hash of the session, and ``path/index`` with the place of every part.

    A file holds the parts of its sessions in order, each as a length-prefixed record that begins with a comment naming session and part.
    """
    parts = cut_lineage(conversation_parts(messages, per_part, labels).withColumn("folder", F.pmod(F.xxhash64("session_id"), F.lit(folders)).cast("int")))
    (parts.select("folder", "session_id", "part", "messages", "first_id", "last_id").write.parquet(f"{path}/index"))
    head = F.concat(F.lit("<!-- "), "session_id", F.lit(" "), F.col("part").cast("string"), F.lit(" -->\n"))
    order = ["folder", "session_id", "part"]
    files.write_text_files(parts.repartitionByRange(*order).sortWithinPartitions(*order).select("folder", F.concat(head, "markdown").alias("text")),
                           f"{path}/pages", "folder", "text", rows_per_file=1000)


def read_conversations(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """(session_id, part, markdown) of written conversations; of one session only its folder is read."""
    pages = f"{path}/pages"
    if session_id is not None:
        found = spark.read.parquet(f"{path}/index").filter(F.col("session_id") == session_id).select("folder").first()
        if found is None:
            return spark.createDataFrame([], "session_id string, part int, markdown string")
        pages += f"/folder={found[0]}"
    head = r"^<!-- (.*) (\d+) -->\n"
    rows = files.read_records(spark, pages).select(F.regexp_extract("text", head, 1).alias("session_id"), F.regexp_extract("text", head, 2).cast("int").alias("part"),
                                                   F.regexp_replace("text", head, "").alias("markdown"))
    return rows if session_id is None else rows.filter(F.col("session_id") == session_id)
