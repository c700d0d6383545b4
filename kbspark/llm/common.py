"""Helpers of the operators: shared scratch tables and words of a batch of texts as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import checkpoint_dir

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = (32, 9, 10, 11, 12, 13)
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting for the rows that travel to Python at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1 << 10) -> Iterator[None]:
    """No more than ``rows`` travel to Python at once meanwhile: rows of whole texts or sets are held by Spark and by Python, for each task."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))  # 0 and less are no limit
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and later stages don't depend on executors that are gone. With ``batch`` in ``small_batches``."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with nullcontext() if batch is None else small_batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_text(df: DataFrame, text: str, *drop: str) -> DataFrame:
    """``df`` without the columns ``drop``, and its text once more as the last column, under a name that no column has."""
    kept = df.drop(*drop)
    return kept.withColumn(free(df, "text"), df[text])


def free(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it, so many that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while (name := "_" + name) in taken:
        pass
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows of the held-out fold; a row without id belongs to neither fold's remainder and counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, the first position of each text, and its length."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(length + 1)])[:-1].astype(np.int64)
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, first, length


def slices(texts: Sequence[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def text_slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows of about so many bytes and their texts, null as empty; a longer text is a range of its own."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    end, begin = np.cumsum(length, dtype=np.int64), 0
    while begin < len(length):
        before = end[begin - 1] if begin else 0
        upto = max(int(np.searchsorted(end, before + size, side="right")), begin + 1)
        yield begin, upto, strings(column.slice(begin, upto - begin))
        begin = upto


def strings(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; the last value must be false."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return edge[::2], edge[1::2]


def word_hashes(cp: np.ndarray, inside: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int | None = None) -> np.ndarray:
    """64-bit hash of each run's code points, of its first ``most`` where given."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    part = (cp[inside].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()), 0x9E3779B97F4A7C15)[place]
    if most is not None:
        part[place >= most] = 0
    return mix(np.add.reduceat(part, at) + np.minimum(size, most or size.max()).astype(np.uint64))


def space_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and the words before each text (one entry more than texts)."""
    cp, first, _ = code_points(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    inside = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    begin, end = runs(inside)
    return word_hashes(cp, inside, begin, end), np.concatenate([np.searchsorted(begin, first), [len(begin)]])


def per_code_point(cp: np.ndarray, rule, dtype) -> np.ndarray:
    """``rule(character)`` for each code point, called once for each distinct one."""
    seen = np.flatnonzero(np.bincount(cp))
    table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, dtype)
    table[seen] = [rule(chr(c)) for c in seen]
    return table[cp]


def lower_letters(cp: np.ndarray) -> np.ndarray:
    """Code points of letters in lower case, 0 for all else."""
    def rule(c: str) -> int:
        low = c.lower()
        return (ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 0

    return per_code_point(cp, rule, np.uint32)
