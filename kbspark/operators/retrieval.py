"""Vector recall, re-ranking and context completion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.text import topics_overlap
from kbspark.operators.paging import own_tenant_first
from kbspark.session import cut_lineage

HIT_SCHEMA = "query_id bigint, query_pos int, chunk_id string, score double"
# Query vectors held by every task of the single-pass plan: 32 MB at most.
BROADCAST_BYTES = 32 << 20
# Chunks compared by one task of the blocked plan, and queries it holds.
BLOCK_CHUNKS = 50_000
BLOCK_QUERIES = 5_000
# Scores computed at once.
TILE = 4_000_000


def _unit_rows(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors as unit rows; a zero vector stays zero, a null or wrongly sized one is an error."""
    if any(v is None or len(v) != dim for v in vectors):
        raise ValueError(f"embedding dimension differs from {dim}")
    m = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then id; ties at the edge are decided by id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _scaled(raw: np.ndarray, scale: str) -> np.ndarray:
    return np.round((1.0 + raw) / 2.0 if scale == "unit" else raw, 6)


def _group_keys(q: pd.DataFrame) -> dict[tuple[str, str], np.ndarray]:
    return {k: np.asarray(v) for k, v in q.groupby(["tenant_code", "system_type"], sort=True).indices.items()}


def fits(dim: int, vector: str = "embedding") -> Column:
    """Whether a vector can be compared: of ``dim`` components, all of them numbers."""
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def rejected_vectors(rows: DataFrame, dim: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(key, reason) of rows that recall leaves out because their vector can't be compared."""
    reason = (F.when(F.col(vector).isNull(), "no vector").when(F.size(vector) != dim, F.concat(F.lit(f"not of {dim} components but "), F.size(vector).cast("string")))
              .otherwise("component is null or not a number"))
    return rows.filter(~fits(dim, vector)).select(key, reason.alias("reason"))


def _visible_chunks(chunks: DataFrame, dim: int) -> DataFrame:
    return (chunks.filter(F.col("enabled") & (F.col("status") == "SUCCESS") & fits(dim))
            .select("chunk_id", "tenant_code", "system_type", F.col("embedding").cast("array<float>").alias("embedding")))


def vector_recall(chunks: DataFrame, queries: DataFrame, k: int = 20, min_score: float = 0.0, scale: str = "unit",
                  scope: str = "strict", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top-k visible chunks per query vector by cosine.

    ``chunks``: chunk_id, tenant_code, system_type, enabled, status, embedding.
    ``queries``: query_id, query_pos, tenant_code, system_type, embedding.
    Query vectors whose counted size is below ``broadcast_bytes`` go to every
    task and the chunks are read once without a shuffle. More queries than
    that take the blocked plan, where no task holds more than one block of
    either side. Both send on at most k rows per query and task. Vectors of another length than the
    longest query's, and those with a null or not-a-number component, are left out; ``rejected_vectors`` lists them.
    """
    cols = [F.col("query_id").cast("bigint").alias("query_id"), F.col("query_pos").cast("int").alias("query_pos"),
            "tenant_code", "system_type", F.col("embedding").cast("array<double>").alias("embedding")]
    # an embedder or a plan behind the vectors runs once
    queries = cut_lineage(queries.select(*cols))
    dim_row = queries.agg(F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    n, dim = int(dim_row["n"] or 0), int(dim_row["dim"] or 0)
    queries = queries.filter(fits(dim))
    visible = _visible_chunks(chunks, dim)
    if n * max(dim, 1) * 8 <= broadcast_bytes:
        hits = _single_pass(visible, queries, dim, k, min_score, scale, scope)
    else:
        hits = _blocked(visible, queries, dim, k, min_score, scale, scope)
    w = Window.partitionBy("query_id", "query_pos").orderBy(F.col("score").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _arrow_unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of a list column without a Python object per row."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (lengths != dim).any():
        raise ValueError(f"embedding dimension differs from {dim}")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Best:
    """The k best hits of each query of one (tenant, system) group so far."""

    def __init__(self, size: int, k: int, min_score: float):
        self.k, self.floor = k, np.full(size, min_score)
        self.ids: list[np.ndarray] = [np.empty(0, dtype=object)] * size
        self.scores: list[np.ndarray] = [np.empty(0)] * size

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of shape (queries, ids); only those at or above a query's current k-th best are looked at."""
        q, r = np.nonzero(scores >= self.floor[:, None])
        starts = np.searchsorted(q, np.arange(len(self.floor) + 1))
        for i in np.unique(q):
            rows = r[starts[i]:starts[i + 1]]
            c_ids, c_sc = np.concatenate([self.ids[i], ids[rows]]), np.concatenate([self.scores[i], scores[i, rows]])
            top = _best(c_ids, c_sc, self.k)
            self.ids[i], self.scores[i] = c_ids[top], c_sc[top]
            if len(top) == self.k:
                self.floor[i] = max(self.floor[i], self.scores[i].min())


def _single_pass(chunks: DataFrame, queries: DataFrame, dim: int, k: int, min_score: float, scale: str,
                 scope: str) -> DataFrame:
    held = queries.toPandas()  # size checked by the caller
    q = chunks.sparkSession.sparkContext.broadcast({
        "id": held["query_id"].to_numpy(), "pos": held["query_pos"].to_numpy(),
        "unit": _unit_rows(held["embedding"], dim), "groups": _group_keys(held)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = q.value
        best = {g: _Best(len(qi), k, min_score) for g, qi in v["groups"].items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _arrow_unit_rows(batch.column("embedding"), dim)
            ids, tenant, system = (np.asarray(batch.column(c).to_pylist(), dtype=object)
                                   for c in ("chunk_id", "tenant_code", "system_type"))
            for (t, s), qi in v["groups"].items():
                mask = system == s
                if not (scope == "admin_all" and t == "0"):
                    mask &= (tenant == t) | (tenant == "0")
                rows = np.flatnonzero(mask)
                step = max(1, TILE // len(qi))
                for part in (rows[i:i + step] for i in range(0, len(rows), step)):
                    best[t, s].add(ids[part], _scaled(v["unit"][qi] @ unit[part].T, scale))
        for g, qi in v["groups"].items():
            for j, c_ids, c_sc in zip(qi, best[g].ids, best[g].scores):
                if len(c_ids):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(c_ids), v["id"][j]), pa.int64()), pa.array(np.full(len(c_ids), v["pos"][j]), pa.int32()),
                        pa.array(c_ids.tolist(), pa.string()), pa.array(c_sc, pa.float64())],
                        names=["query_id", "query_pos", "chunk_id", "score"])

    # Each task sends k rows per query, so a few waves of larger tasks send less than one task per split.
    waves = 4 * chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.coalesce(waves).mapInArrow(scan, HIT_SCHEMA)


def _blocked(chunks: DataFrame, queries: DataFrame, dim: int, k: int, min_score: float, scale: str,
             scope: str, block_chunks: int = BLOCK_CHUNKS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Chunks and queries meet by (system, tenant) in bounded blocks.

    A query looks at its own tenant and at '0' (at every tenant under
    ``admin_all``), so each side is keyed by the chunk's tenant. The number of
    blocks of a key follows its row count, hence a dominant tenant is split.
    """
    key = ["system_type", "tenant_key"]
    c = chunks.withColumnRenamed("tenant_code", "tenant_key")
    tenants = F.when(F.col("tenant_code") == "0", F.array(F.lit("0"))).otherwise(F.array(F.col("tenant_code"), F.lit("0")))
    q = queries.withColumn("tenant_key", F.explode(tenants))
    sizes = c.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_chunks).cast("int").alias("n_cb"))
    if scope == "admin_all":
        admin = queries.filter(F.col("tenant_code") == "0").join(
            sizes.filter(F.col("tenant_key") != "0").select(*key), "system_type")
        q = q.unionByName(admin.select(*q.columns))
    q_sizes = q.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("n_qb"))
    both = sizes.join(q_sizes, key)
    blocks = both.select(*key, "n_cb", "n_qb")
    cb = F.pmod(F.xxhash64("chunk_id"), F.col("n_cb")).cast("int")
    qb = F.pmod(F.xxhash64("query_id", "query_pos"), F.col("n_qb")).cast("int")
    left = (c.join(blocks, key).withColumn("cb", cb)
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1)))
            .select(*key, "cb", "qb", "chunk_id", "embedding"))
    right = (q.join(blocks, key).withColumn("qb", qb)
             .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n_cb") - 1)))
             .select(*key, "cb", "qb", "query_id", "query_pos", "embedding"))

    def compare(cs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if cs.empty or qs.empty:
            return pd.DataFrame(columns=["query_id", "query_pos", "chunk_id", "score"])
        cu, ids, out = _unit_rows(cs["embedding"], dim), cs["chunk_id"].to_numpy(), []
        for start in range(0, len(qs), 64):
            part = qs.iloc[start:start + 64]
            scores = _scaled(_unit_rows(part["embedding"], dim) @ cu.T, scale)
            for (qid, pos), one in zip(part[["query_id", "query_pos"]].itertuples(index=False), scores):
                ok = np.flatnonzero(one >= min_score)
                top = ok[_best(ids[ok], one[ok], k)]
                out.append(pd.DataFrame({"query_id": qid, "query_pos": pos, "chunk_id": ids[top], "score": one[top]}))
        return pd.concat(out)

    meet = [*key, "cb", "qb"]
    return left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(compare, HIT_SCHEMA)


def centroid(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector per key and length of vector: a task sums the vectors of each key it meets, and one row per key and task is shuffled.

    A component that is null counts in no mean; null and empty vectors count nothing.
    """
    rows = df.filter(F.size(vector) > 0).select(*keys, F.size(vector).alias("__dim"), F.col(vector).cast("array<double>").alias("__v"))
    names, kinds = rows.columns[:-1], rows.schema.fields[:-1]
    out = T.StructType([*kinds, T.StructField("__sum", T.ArrayType(T.DoubleType())), T.StructField("__n", T.ArrayType(T.LongType()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        schema = None

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*held))]
            both = [pa.array([v[k].tolist() for v in held.values()], pa.list_(t)) for k, t in ((0, pa.float64()), (1, pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, *both], [*names, "__sum", "__n"])

        for b in batches:
            schema = b.schema
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b.select(names)]).append_column("__at", pa.array(np.arange(b.num_rows)))
            groups = table.group_by(names).aggregate([("__at", "list")])
            flat, offsets = b.column(len(names)).flatten(), np.concatenate([[0], np.cumsum(b.column(len(names)).value_lengths().to_numpy())])
            values = flat.to_numpy(zero_copy_only=False)
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            for key, at in zip(zip(*(groups[c].to_pylist() for c in names)), groups["__at_list"].to_pylist()):
                spots = offsets[np.array(at)][:, None] + np.arange(key[-1])
                total = [np.where(known[spots], values[spots], 0).sum(axis=0), known[spots].sum(axis=0)]
                held[key] = [x + y for x, y in zip(held[key], total)] if key in held else total
            if len(held) * key[-1] > 1 << 20:  # many keys: hand out what there is
                yield flush()
                held.clear()
        if held:
            yield flush()

    add = lambda c: F.reduce(F.collect_list(c), F.array_repeat(F.lit(0).cast("double"), F.max("__dim")), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    total = rows.mapInArrow(sums, out).groupBy(*names).agg(add("__sum").alias("__s"), add(F.col("__n").cast("array<double>")).alias("__c"))
    return total.select(*keys, F.zip_with("__s", "__c", lambda s, n: F.when(n > 0, s / n)).alias(vector))


def merge_variants(hits: DataFrame, chunks: DataFrame, keep: str = "first") -> DataFrame:
    """One hit per question, document and chunk index over its query variants.

    ``first`` keeps the hit of the earliest variant, ``best`` the best score.
    """
    h = hits.join(chunks.select("chunk_id", "doc_code", "chunk_index"), "chunk_id")
    order = [F.col("query_pos").asc(), F.col("score").desc(), F.col("chunk_id").asc()]
    if keep == "best":
        order = [F.col("score").desc(), F.col("query_pos").asc(), F.col("chunk_id").asc()]
    w = Window.partitionBy("query_id", "doc_code", "chunk_index").orderBy(*order)
    return h.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def local_rerank(hits: DataFrame, top_n: int, threshold: float, floor: float = 0.85, score: str = "score") -> DataFrame:
    """Score at or above max(threshold, floor) (null passes) and topics in common, best ``top_n`` per question.

    ``hits`` carries query_topics and doc_topics.
    """
    good = F.col(score).isNull() | (F.col(score) >= max(threshold, floor))
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), "chunk_id")
    return (hits.filter(good & topics_overlap("query_topics", "doc_topics"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, top_n)))


def external_rerank(candidates: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Candidates with text that the score table returns at or above the threshold (null passes), in its order."""
    text = F.trim(F.coalesce("content", F.lit(""))) != ""
    s = scores.filter(F.col("rerank_score").isNull() | (F.col("rerank_score") >= threshold))
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "chunk_id")
    return candidates.filter(text).join(s, ["query_id", "chunk_id"]).withColumn("rank", F.row_number().over(w))


def score_candidates(candidates: DataFrame, scorer: Callable[[list[str], list[str]], list[float | None]],
                     query_text: str = "question", text: str = "content") -> DataFrame:
    """Score table of any relevance scorer called on Arrow batches of (question, text) pairs; blank texts are not sent."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                scores = scorer(pdf[query_text].tolist(), pdf[text].tolist())
                yield pdf[["query_id", "chunk_id"]].assign(rerank_score=pd.Series(scores, index=pdf.index, dtype="float64"))

    sent = candidates.filter(F.trim(F.coalesce(text, F.lit(""))) != "").select("query_id", "chunk_id", query_text, text)
    return sent.mapInPandas(run, "query_id bigint, chunk_id string, rerank_score double")


def rerank(candidates: DataFrame, scores: DataFrame | None, top_n: int, threshold: float, floor: float = 0.85,
           external_threshold: float = 0.85) -> DataFrame:
    """External scores for questions that have any, the local rule for the others; ``source`` tells which.

    The result is ordered per question by ``position``: own tenant first, then rank.
    """
    out = ["query_id", "chunk_id", "tenant_code", "doc_tenant", "score", "rank", "source"]
    if scores is None:
        both = local_rerank(candidates, top_n, threshold, floor).withColumn("source", F.lit("local")).select(*out)
    else:
        served = scores.select("query_id").distinct()
        ext = (external_rerank(candidates, scores, external_threshold)
               .withColumns({"source": F.lit("external")}).select(*out))
        loc = (local_rerank(candidates.join(served, "query_id", "left_anti"), top_n, threshold, floor)
               .withColumn("source", F.lit("local")).select(*out))
        both = ext.unionByName(loc)
    own = own_tenant_first(F.col("tenant_code"), F.col("doc_tenant"))
    w = Window.partitionBy("query_id").orderBy(own, "rank")
    return both.withColumn("position", F.row_number().over(w))


def parent_ids(hits: DataFrame) -> DataFrame:
    """Distinct non-blank parent ids as chunk_id."""
    p = F.trim(F.coalesce("parent_chunk_id", F.lit("")))
    return hits.filter(p != "").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()


def parent_contents(hits: DataFrame, coarse: DataFrame) -> DataFrame:
    """Distinct parent texts per question."""
    p = (hits.filter(F.trim(F.coalesce("parent_chunk_id", F.lit(""))) != "")
         .select("query_id", F.col("parent_chunk_id").alias("chunk_id")).distinct())
    found = p.join(coarse.select("chunk_id", "content"), "chunk_id").filter(F.col("content").isNotNull())
    return found.groupBy("query_id", "content").agg(F.min("chunk_id").alias("chunk_id"))


def source_struct(unknown_file: str = "unknown file", untitled: str = "untitled document") -> Column:
    return F.struct(F.coalesce("file_name", F.lit(unknown_file)).alias("file_name"),
                    F.coalesce("title", F.lit(untitled)).alias("title"), "doc_code", "tenant_code", "chunk_index",
                    F.coalesce("page_number", F.lit("1")).alias("page_number"), "title_hierarchy", "content",
                    F.lit(False).alias("deleted"))


def joined(rows: DataFrame, order: list[str], text: str, sep: str, out: str) -> DataFrame:
    """Texts of each question joined in order; rows per question are bounded by the recall limits."""
    piece = F.struct(*order, F.col(text).alias("t"))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), sep).alias(out))


def graph_context(paths: DataFrame, max_chars: int | None = None, cut_mark: str = "\n... (graph context cut)") -> DataFrame:
    """Distinct source and other texts in path order, joined; with ``max_chars`` cut there and marked."""
    flat = paths.select("query_id", "rank", F.posexplode(F.array("source_content", "other_content")).alias("side", "t"))
    first = (flat.filter(F.col("t").isNotNull()).groupBy("query_id", "t")
             .agg(F.min(F.struct("rank", "side")).alias("at")))
    text = joined(first, ["at"], "t", "\n***\n", "g")
    if max_chars is None:
        return text.withColumnRenamed("g", "graph_context")
    return text.select("query_id", F.when(F.length("g") > max_chars, F.concat(F.substring("g", 1, max_chars), F.lit(cut_mark)))
                       .otherwise(F.col("g")).alias("graph_context"))


def assemble_context(questions: DataFrame, vector_ctx: DataFrame, coarse_ctx: DataFrame, graph_ctx: DataFrame) -> DataFrame:
    """Fine texts, parent texts and graph texts under their headings, one row per question with any hit."""
    t = lambda c: F.coalesce(c, F.lit(""))
    coarse = F.when(t("coarse_context") != "", F.concat(F.lit("\n[Wider context]\n"), F.col("coarse_context"))).otherwise("")
    full = F.concat(F.lit("[Retrieved passages]\n"), F.col("vector_context"), coarse, F.lit("\n[Related by graph]\n"), t("graph_context"))
    return (questions.join(vector_ctx, "query_id").join(coarse_ctx, "query_id", "left").join(graph_ctx, "query_id", "left")
            .select("query_id", full.alias("context")))

