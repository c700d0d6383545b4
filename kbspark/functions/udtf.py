"""Chunk text as a lateral table function in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kbspark.operators.chunking import COARSE, split_at_boundaries


class ChunkText:
    """Pieces of one text: ``SELECT d.id, c.* FROM docs d, LATERAL chunk_text(d.text, 448, 112, 512) c``."""

    def eval(self, text: str, target: int = COARSE.target, overlap: int = 256, maximum: int = COARSE.maximum) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_at_boundaries(text or "", target, overlap, maximum))


def register_chunk_text(spark: SparkSession, name: str = "chunk_text") -> None:
    spark.udtf.register(name, udtf(ChunkText, returnType="piece_no int, piece string"))
