"""Exact top-k by inner product without random access: sorted lists are read in sequence until nobody outside can qualify.

Rows lie in blocks; a block has one list a component, its rows by descending value. A query reads a list from the top where its own component is positive and from the
bottom where it is negative, so contributions only fall. What a list has not shown lies between its last value and the value reached: the sum of what a row
has shown, with the last values for the rest, is its lower bound, and the rest's whole range on top its upper bound. Lists with most range left are read
first. Reading stops when the rows whose upper bound reaches the k-th lower bound (or the k-th score of blocks read before) are few; their final scores are then resolved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.llm import vectors as V

#: Steps in which a list is read, and the share of a block (and rows) that may be left when final scores are resolved.
STEPS, LEFT_SHARE, LEFT_ROWS = 4, 32, 64
INDEX = "dim int, block bigint, rows binary, ids binary, v binary, lists binary"


def _index(group: pa.Table) -> pa.Table:
    """A block's row numbers, ids, vectors, and its sorted lists: for each component the rows by descending value."""
    dim = group["dim"][0].as_py()
    packed = b"".join(group["v"].to_pylist())
    v = np.frombuffer(packed, "<i4").reshape(-1, dim)
    lists = np.argsort(-v.T.astype(np.int64), axis=1, kind="stable").astype("<u4")
    rows, ids = (group[c].to_numpy().astype("<i8").tobytes() for c in ("row", "id"))
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": [group["bucket"][0].as_py()], "rows": pa.array([rows], pa.binary()), "ids": pa.array([ids], pa.binary()),
                     "v": pa.array([packed], pa.binary()), "lists": pa.array([lists.tobytes()], pa.binary())})


class Lists:
    """Sorted lists of one block, each from its largest and from its smallest value, in ``STEPS`` parts."""

    def __init__(self, v: np.ndarray, lists: np.ndarray) -> None:
        self.v, self.n, self.dim = v, len(v), v.shape[1]
        falling = np.take_along_axis(v.T, lists, axis=1)
        step = -(-self.n // STEPS)
        fill = ((0, 0), (0, step * STEPS - self.n))
        # list d falls; list dim + d is the same from its end, with the sign of its values turned; filled up by a row that is not there
        member = np.pad(np.concatenate([lists, lists[:, ::-1]]).astype(np.int64), fill, constant_values=self.n)
        self.member = member.reshape(2 * self.dim, STEPS, step)
        self.value = np.pad(np.concatenate([falling, -falling[:, ::-1]]), fill, mode="edge").reshape(2 * self.dim, STEPS, step)

    def top(self, q: np.ndarray, k: int, bar: float, skip: int | None) -> tuple[np.ndarray, int]:
        """Rows that may be among the k best of at least ``bar``, without row ``skip``, and how many list entries were read."""
        n, weight = self.n, np.abs(q)
        line = np.flatnonzero(weight)
        at, weight = np.where(q[line] > 0, line, line + self.dim), weight[line]
        last = weight * self.value[at, -1, -1]
        front = weight * self.value[at, 0, 0]
        bound = np.full(n + 1, last.sum(), self.v.dtype)
        low = bound[:n]  # with nothing read, every row may have each list's last value
        depth, read = np.zeros(len(at), np.int64), 0
        if skip is not None:
            low[skip] -= np.abs(front - last).sum() + np.abs(low[0]) + 1  # never a bound for others; it is dropped at the end
        while True:
            rest = (front - last).sum()
            kth = np.partition(low, n - k)[n - k] if n > k else low.min()
            bar = max(bar, kth) if n - (skip is not None) >= k else bar
            left = np.flatnonzero(low + rest >= bar)
            if rest == 0 or len(left) <= max(LEFT_ROWS, n // LEFT_SHARE):
                return left[left != skip] if skip is not None else left, read
            most = np.flatnonzero((front > last) & ((front - last) * len(at) >= rest))
            part = (at[most], depth[most])
            shown = weight[most, None] * self.value[part] - last[most, None]
            if self.v.dtype == np.float64:
                bound += np.bincount(self.member[part].ravel(), shown.ravel(), n + 1)
            else:
                np.add.at(bound, self.member[part].ravel(), shown.ravel())
            read += shown.size
            depth[most] += 1
            open_lists = depth[most] < STEPS
            front[most] = np.where(open_lists, weight[most] * self.value[at[most], np.minimum(depth[most], STEPS - 1), 0], last[most])


def _search(k: int):
    def kernel(tile: pa.Table) -> pa.Table:
        kind = tile["kind"].to_numpy()
        blocks, queries = tile.filter(pa.array(kind == 0)), tile.filter(pa.array(kind == 1))
        none = pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "id", "score")})
        if not len(blocks) or not len(queries):
            return none
        dim = queries["dim"][0].as_py()
        q = np.frombuffer(b"".join(queries["q"].to_pylist()), "<i4").reshape(-1, dim)
        top = int(np.abs(q).max())
        q_row, q_id = queries["row"].to_numpy(), queries["id"].to_numpy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        for b in range(len(blocks)):
            v = np.frombuffer(blocks["v"][b].as_py(), "<i4").reshape(-1, dim)
            kept = v.astype(V.exact(v, dim, top))
            lists = Lists(kept, np.frombuffer(blocks["lists"][b].as_py(), "<u4").reshape(dim, -1))
            rows, ids = (np.frombuffer(blocks[c][b].as_py(), "<i8") for c in ("rows", "ids"))
            place = {r: i for i, r in enumerate(rows.tolist())}
            for i, r in enumerate(q_row.tolist()):
                scores, found = best[i]
                own = q[i].astype(kept.dtype)
                left, _ = lists.top(own, k, scores[-1] if len(scores) == k else -np.inf, place.get(r))
                scores, found = np.concatenate([scores, (kept[left] @ own).astype(np.int64)]), np.concatenate([found, ids[left]])
                by = np.lexsort((found, -scores))[:k]
                best[i] = scores[by], found[by]
        number = [len(s) for s, _ in best]
        return pa.table({"query_row": np.repeat(q_row, number), "query_id": np.repeat(q_id, number), "id": np.concatenate([f for _, f in best]),
                         "score": np.concatenate([s for s, _ in best])})

    return kernel


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``df`` that ``queries`` (a condition on ``id``) selects, the k other rows of the greatest inner product.

    Components are floor(256 x). Ties go to the smaller id. A query has fewer rows where fewer others take part, none where it is alone. Rows without id or vector, with an
    empty vector, or with a null, non-finite or too large component (65,536 and more) take no part. Vectors of other lengths never meet. Rows that
    share an id, or are equal in everything, are rows of their own: each is a query and a candidate for the other ones. Other columns are not read.
    """
    rows = V.quantised(df, key, vector)
    n = max(-(-V.values(rows) // V.BLOCK_VALUES), 1)
    bucket = F.pmod(F.xxhash64("row"), F.lit(n))
    index = C.written(rows.select("row", "id", "dim", "v", bucket.alias("bucket")).groupBy("dim", "bucket").applyInArrow(_index, INDEX), "sorted-lists")
    asked = rows.filter(queries).select("row", "id", "dim", F.col("v").alias("q"))
    found = V.tiles(index, asked, _search(k), "query_row bigint, query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
