"""Exact vector recall from the chunk store that skips cells which cannot hold a hit.

The cosine of a query with any vector of a cell is at most cos(max(0, angle to the centre - radius)), by the triangle inequality on angles. Each query
first looks into its most promising cells until they hold k vectors; the k-th score found is a bar, and of the other cells only those whose
bound reaches it are read. Tenants and systems of the questions prune the store's folders before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.retrieval import _best, _scaled
from kbspark.session import cut_lineage
from kbspark.sources.store import ChunkStore, unit_rows

#: Queries that meet one cell in one group.
QUERY_BLOCK = 5_000
#: Scores are rounded to six places; no bound may fall below a score by that.
SLACK = 2e-6
HITS = "query_id bigint, query_pos int, chunk_id string, score double"
KEY = ["tenant_code", "system_type", "cell"]


def _bound(scale: str) -> Column:
    dot = F.aggregate(F.zip_with("center", "unit", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    best = F.cos(F.greatest(F.lit(0.0), angle - F.col("radius") - F.lit(1e-7)))
    return ((best + 1) / 2 if scale == "unit" else best) + F.lit(SLACK)


def _compare(k: int, min_score: float, scale: str):
    def kernel(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if len(chunks) and len(queries):
            unit = unit_rows(np.array(chunks["embedding"].to_pylist(), np.float64))
            ids = np.asarray(chunks["chunk_id"].to_pylist(), dtype=object)
            asked = np.array(queries["unit"].to_pylist(), np.float64)
            for begin in range(0, len(asked), 256):
                scores = _scaled(asked[begin:begin + 256] @ unit.T, scale)
                for i, one in enumerate(scores):
                    ok = np.flatnonzero(one >= min_score)
                    top = ok[_best(ids[ok], one[ok], k)]
                    row = begin + i
                    out.append(pa.table({"query_id": pa.array([queries["query_id"][row].as_py()] * len(top), pa.int64()), "query_pos": pa.array([queries["query_pos"][row].as_py()] * len(top), pa.int32()),
                                         "chunk_id": pa.array(ids[top].tolist(), pa.string()), "score": pa.array(one[top], pa.float64())}))
        empty = pa.table({"query_id": pa.array([], pa.int64()), "query_pos": pa.array([], pa.int32()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *out])

    return kernel


def recall_from_store(store: ChunkStore, queries: DataFrame, k: int = 20, min_score: float = 0.0, scale: str = "unit", scope: str = "strict",
                      version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Top-k visible chunks of each query vector as ``vector_recall`` gives them, and a report: query, cells visible, read and skipped.

    ``queries``: query_id, query_pos, tenant_code, system_type, embedding; those with a null, empty or zero vector, or of a dimension that no chunk has, find
    nothing. Chunks count when enabled and SUCCESS. Cells hold 2,048 vectors at most and queries meet them in blocks, so no group grows with either side.
    """
    version = store.version() if version is None else version
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    q = queries.filter(usable).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query_pos").cast("int").alias("query_pos"), F.col("tenant_code").alias("t"),
                                      F.col("system_type").alias("s"), F.col("embedding").cast("array<double>").alias("v")).withColumn("norm", norm)
    # the vectors come from an embedder or a plan: written once, read by every step
    q = cut_lineage(q.filter("norm > 0").select("query_id", "query_pos", "t", "s", F.transform("v", lambda x: x / F.col("norm")).alias("unit")))
    asked = {tuple(r) for r in q.select("t", "s").distinct().collect()}  # one row for each tenant and system that asks
    everywhere = scope == "admin_all" and any(t == "0" for t, _ in asked)
    tenants = None if everywhere else sorted({t for t, _ in asked if t is not None} | {"0"})
    systems = sorted({s for _, s in asked if s is not None})
    tenant_keys = F.when(F.col("t") == "0", F.array(F.lit("0"))).otherwise(F.array("t", F.lit("0")))
    cells = store.cells(version, tenants, systems)
    mine = q.withColumn("tenant_code", F.explode(tenant_keys)).join(cells.withColumnRenamed("system_type", "s"), ["tenant_code", "s"])
    if everywhere:
        mine = mine.unionByName(q.filter("t = '0'").join(cells.filter("tenant_code <> '0'").withColumnRenamed("system_type", "s"), "s").select(*mine.columns))
    pairs = mine.filter(F.size("unit") == F.col("dim")).select("query_id", "query_pos", "tenant_code", F.col("s").alias("system_type"), "cell", "n", _bound(scale).alias("bound"))
    per_query = Window.partitionBy("query_id", "query_pos").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    pairs = cut_lineage(pairs.filter(F.col("bound") >= min_score).withColumn("first", F.coalesce(F.sum("n").over(per_query), F.lit(0)) < k))
    chunks = (store.read(version, tenants, systems).filter((F.col("enabled")) & (F.col("status") == "SUCCESS") & F.col("cell").isNotNull())
              .select(*KEY, "chunk_id", "embedding"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))

    def scan(some: DataFrame) -> DataFrame:
        wanted = some.select(*KEY).distinct()
        left = chunks.join(wanted, KEY, "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = (some.select("query_id", "query_pos", *KEY).join(q.select("query_id", "query_pos", "unit"), ["query_id", "query_pos"])
                 .withColumn("block", F.pmod(F.xxhash64("query_id", "query_pos"), F.lit(blocks)).cast("int")))
        return left.groupBy(*KEY, "block").cogroup(right.groupBy(*KEY, "block")).applyInArrow(_compare(k, min_score, scale), HITS)

    best = Window.partitionBy("query_id", "query_pos").orderBy(F.desc("score"), "chunk_id")

    def top(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    near = cut_lineage(top(scan(pairs.filter("first"))))
    bar = near.filter(F.col("rank") == k).select("query_id", "query_pos", F.col("score").alias("bar"))
    judged = cut_lineage(pairs.join(bar, ["query_id", "query_pos"], "left").withColumn("open", F.col("first") | F.col("bar").isNull() | (F.col("bound") >= F.col("bar"))).drop("bar"))
    rest = scan(judged.filter("open AND NOT first"))
    report = judged.groupBy("query_id", "query_pos").agg(F.count("*").alias("cells"), F.count_if("open").alias("cells_read"), F.count_if(~F.col("open")).alias("cells_skipped"))
    return top(near.drop("rank").unionByName(rest)), report
