"""Integer vectors in blocks, and tiles in which blocks of queries meet blocks of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm import common as C

#: A component x becomes floor(GRID * x).
GRID = 256
#: Greatest component that takes part, so that no score of up to 32,767 components leaves 64 bits.
LARGEST = 1 << 24
#: Components of one block of rows, of one block of queries, and blocks of rows in one tile. They bound what a task holds.
BLOCK_VALUES, QUERY_VALUES, TILE_BLOCKS = 1 << 18, 1 << 20, 8
ROWS = "row bigint, id bigint, label bigint, dim int, key bigint, v binary"


def quantised(df: DataFrame, key: str, vector: str, label: Column | None = None) -> DataFrame:
    """A written table of ``row`` (a number for each row of ``df``), ``id``, ``label``, ``dim``, the first component as ``key``, and all as packed integers.

    Rows without id or label, without vector, with an empty one, or with a null, non-finite or too large component are left out.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("bigint").alias("id"),
                     (F.lit(0) if label is None else label).cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(3)
            size = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(GRID * flat)
                fine = np.abs(x) < LARGEST  # false where null or not finite
            first = np.cumsum(size) - size
            ok = np.logical_and.reduceat(fine, first) if len(size) else np.zeros(0, bool)
            x = np.where(fine, x, 0).astype("<i4")
            packed = [x[i:i + n].tobytes() for i, n in zip(first.tolist(), size.tolist())]
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(size.astype(np.int32)), pa.array(x[first].astype(np.int64)), pa.array(packed, pa.binary())],
                                             ["row", "id", "label", "dim", "key", "v"])
            yield out.filter(pa.array(ok))

    return C.written(rows.mapInArrow(kernel, ROWS), "vectors")


def matrix(packed: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one dimension as rows, in a type in which sums of products are exact: float64 where they stay below 2^53, else int64."""
    v = np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(-1, dim)
    return v.astype(exact(v, dim))


def exact(v: np.ndarray, dim: int, other: int = LARGEST) -> type:
    top = int(np.abs(v).max(initial=0))
    return np.float64 if dim * max(top, 1) * max(min(other, LARGEST), 1) < 1 << 53 else np.int64


def values(rows: DataFrame) -> int:
    """Components of all rows."""
    return int(rows.agg(F.sum("dim")).first()[0] or 0)


def tiles(blocks: DataFrame, queries: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``kernel`` over each tile: one block of queries and up to about ``TILE_BLOCKS`` blocks of rows of the same dimension.

    ``blocks`` has ``dim``, ``block`` and packed columns, ``queries`` is like ``quantised`` rows with further columns. A tile's table has ``kind`` (0: block, 1: query), and
    null in the columns of the other kind. Both sides are copied so often as the other has blocks, and no pair of rows is made.
    """
    spark = blocks.sparkSession
    n_blocks, parallel = blocks.count(), spark.sparkContext.defaultParallelism
    columns = max(-(-n_blocks // TILE_BLOCKS), min(n_blocks, parallel), 1)
    lines = max(-(-values(queries) // QUERY_VALUES), 1)
    left = (blocks.withColumn("kind", F.lit(0)).withColumn("tile", F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int"))
            .withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))))
    right = (queries.withColumn("kind", F.lit(1)).withColumn("line", F.pmod(F.xxhash64("row"), F.lit(lines)).cast("int"))
             .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))))
    return left.unionByName(right, allowMissingColumns=True).groupBy("dim", "line", "tile").applyInArrow(kernel, schema)
