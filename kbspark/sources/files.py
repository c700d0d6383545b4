"""Whole-file text reading and writing (S1, X7 input)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.scalars import base_name, file_extension
from kbspark.session import checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def read_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: path, name, text, size. Files are whole and UTF-8."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"),
                    F.col("_metadata.file_size").alias("file_size"))
            .withColumn("file_name", base_name("path")))


def read_binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Bytes decoded as UTF-8, with the extension, for files of unknown kind."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
            .select("path", base_name("path").alias("file_name"), F.col("length").alias("file_size"),
                    F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
            .withColumn("ext", file_extension("file_name")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below ``path`` without reading the contents."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("length").alias("file_size")))


def _arriving(spark: SparkSession, path: str, glob: str, most: int) -> DataFrame:
    """Arriving files below ``path`` as a stream of path, length and content, ``most`` files a micro-batch."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    return (spark.readStream.schema(kinds).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(path)
            .select("path", "length", "content"))


def stream_files(spark: SparkSession, path: str, glob: str = "*", most: int = 1000) -> DataFrame:
    """Arriving files as a stream of path, file_size and text (null where the bytes are not UTF-8), ``most`` files a micro-batch."""
    return _arriving(spark, path, glob, most).select("path", F.col("length").alias("file_size"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def stream_records(spark: SparkSession, path: str, glob: str = "*", most: int = 1000) -> DataFrame:
    """Records of arriving files as a stream of path and content, the record's bytes, ``most`` files a micro-batch."""
    return _arriving(spark, path, glob, most).select("path", "content").mapInArrow(_records, "path string, content binary")


def write_documents(df: DataFrame, path: str, name: str, text: str) -> None:
    """A file for each row, below a folder with its ``name``; the text is followed by one line feed. Null is an empty text."""
    (df.select(F.col(name), F.coalesce(F.col(text), F.lit("")).alias("value")).write.mode("append").partitionBy(name).option("maxRecordsPerFile", 1).text(path))


def write_text_files(df: DataFrame, path: str, folder: str, text: str, rows_per_file: int = 1) -> None:
    """Files below one folder per value of ``folder`` with ``rows_per_file`` records each: the length in bytes, a line feed, the UTF-8 text and a line feed.

    Any text comes back whole, whatever it holds. A null text has the length -1 and no bytes.
    """
    size = F.octet_length(F.col(text).cast("binary"))
    record = F.concat(F.coalesce(size, F.lit(-1)).cast("string"), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    (df.select(F.col(folder), record.alias("value")).write.partitionBy(folder)
     .option("maxRecordsPerFile", rows_per_file).option("lineSep", "\n").text(path))


def write_records(df: DataFrame, path: str, text: str, size: int = 1 << 20) -> None:
    """Adds files of about ``size`` bytes to ``path``, with records as ``write_text_files`` makes them; a larger text has a file of its own."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for x in b.column(0):
                whole = x.as_py()
                if out and held + len(whole or b"") > size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary())], ["value"])
                    out, held = [], 0
                out.append(b"-1\n" if whole is None else b"%d\n%b" % (len(whole), whole))
                held += len(out[-1])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], pa.binary())], ["value"])

    # the line feed behind the last record of a file is the writer's
    (df.select(F.col(text).cast("binary")).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
     .write.mode("append").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of each record of files, null for a null text; a file whose lengths don't fit its bytes is an error that names it."""
    for b in batches:
        for name, content in zip(b.column(0), b.column(1)):
            whole, at, out, size = content.as_py(), 0, [], 0
            while at < len(whole):
                end = whole.find(b"\n", at)
                n = int(whole[at:end]) if end > at else -2
                if n < -1 or end + 1 + max(n, 0) >= len(whole) or whole[end + 1 + max(n, 0)] != 10:
                    raise ValueError(f"record at byte {at} of {name.as_py()} is damaged")
                out.append(None if n < 0 else whole[end + 1:end + 1 + n])
                size += max(n, 0)
                at = end + 2 + max(n, 0)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(out), pa.string()), pa.array(out, pa.binary())], ["path", "content"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(out), pa.string()), pa.array(out, pa.binary())], ["path", "content"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files written by ``write_text_files`` or ``write_records``; a file whose lengths don't fit its bytes is an error that names it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return raw.mapInArrow(_records, "path string, content binary").select("path", F.validate_utf8(F.col("content").cast("string")).alias("text"))
