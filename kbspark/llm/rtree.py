"""Hard negatives by best-first search of STR-packed R-trees over integer vectors.

Rows are cut into slabs by label and first component (a range shuffle), and each slab's blocks are tiled by their widest components into leaves (sort-tile-recursive).
Leaves and groups of leaves have minimum bounding boxes; a box and an anchor give an interval of inner products, component by component. A queue takes the box of the
highest upper end first. A box is pruned when no wanted window of scores meets its interval, when its upper end is strictly below the k-th score of each such window, or
when it holds no row of a wanted label.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.llm import vectors as V

#: Rows of a leaf, leaves of an inner box, and components by which a block is tiled.
LEAF, FAN, TILED = 64, 16, 3
TREE = "dim int, block bigint, rows binary, ids binary, labels binary, v binary, leaves binary"
#: Beyond every score.
ANY = (1 << 63) - 1
FOUND = "anchor_row bigint, anchor_id bigint, window int, row bigint, id bigint, score bigint"


def str_order(v: np.ndarray, leaf: int = LEAF, tiled: int = TILED) -> np.ndarray:
    """Rows in sort-tile-recursive order by their widest components, leaves being ``leaf`` rows in sequence."""
    pages = -(-len(v) // leaf)
    if pages < 2:
        return np.arange(len(v))
    wide = np.argsort(v.min(axis=0).astype(np.int64) - v.max(axis=0), kind="stable")[:tiled].tolist()

    def tile(rows: np.ndarray, by: list[int]) -> list[np.ndarray]:
        rows = rows[np.argsort(v[rows, by[0]], kind="stable")]
        here = -(-len(rows) // leaf)
        slabs = max(round(here ** (1 / len(by))), 1)
        if len(by) == 1 or here < 2:
            return [rows]
        size = -(-here // slabs) * leaf
        return [x for i in range(0, len(rows), size) for x in tile(rows[i:i + size], by[1:])]

    return np.concatenate(tile(np.arange(len(v)), wide))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of packed leaves from rows sorted by dimension, label and first component; a leaf holds one label where the label has rows enough."""
    names = ["dim", "block", "rows", "ids", "labels", "v", "leaves"]
    for b in batches:
        dims = b.column(3).to_numpy()
        cut = np.append(np.flatnonzero(np.diff(dims, prepend=-1)), len(dims)).tolist()
        for begin, end in zip(cut, cut[1:]):
            dim = int(dims[begin])
            most = max(V.BLOCK_VALUES // dim, 1)
            for i in range(begin, end, most):
                part = b.slice(i, min(most, end - i))
                row, ids, label = (part.column(c).to_numpy() for c in (0, 1, 2))
                v = np.frombuffer(b"".join(part.column(5).to_pylist()), "<i4").reshape(-1, dim)
                edge = np.append(np.flatnonzero(np.diff(label, prepend=label[0])), len(label))
                edge = np.insert(edge, 0, 0) if len(edge) and edge[0] else edge
                if len(edge) > max(len(label) // LEAF, 1) + 1:  # labels of few rows share leaves
                    edge = np.array([0, len(label)])
                order, leaves = [], []
                for x, y in zip(edge.tolist(), edge[1:].tolist()):
                    order.append(str_order(v[x:y]) + x)
                    leaves += [min(LEAF, y - at) for at in range(x, y, LEAF)]
                o = np.concatenate(order)
                packed = [row[o].astype("<i8"), ids[o].astype("<i8"), label[o].astype("<i8"), v[o], np.array(leaves, "<i4")]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(row.min())]), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names)


class Tree:
    """Leaves of all blocks of a tile, with boxes of leaves and of groups of leaves."""

    def __init__(self, blocks: pa.Table, dim: int, top: int) -> None:
        def whole(column: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(blocks[column].to_pylist()), kind)

        v = whole("v", "<i4").reshape(-1, dim)
        self.v = v.astype(V.exact(v, dim, top))
        self.row, self.id, self.label = (whole(c, "<i8") for c in ("rows", "ids", "labels"))
        self.edge = np.concatenate([[0], np.cumsum(whole("leaves", "<i4"), dtype=np.int64)])
        first = self.edge[:-1]
        group = np.arange(0, len(first), FAN)
        self.low, self.high = np.minimum.reduceat(self.v, first), np.maximum.reduceat(self.v, first)
        self.least, self.most = np.minimum.reduceat(self.label, first), np.maximum.reduceat(self.label, first)
        self.group_low, self.group_high = np.minimum.reduceat(self.low, group), np.maximum.reduceat(self.high, group)
        self.group_least, self.group_most = np.minimum.reduceat(self.least, group), np.maximum.reduceat(self.most, group)

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> tuple[list[list[tuple[int, int, int]]], int]:
        """For each window the k best rows (-score, id, row) of the anchor's label, or of others where not ``same``; and how many leaves were read."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        upper = np.array([w[1] for w in windows]).astype(self.v.dtype)
        floor = np.array([w[0] for w in windows]).astype(self.v.dtype)  # the window's lower end, or its k-th score once there are k

        def boxes(low, high, least, most, at):
            """Upper ends, and which boxes some window may still take rows from."""
            top, bottom = high @ up + low @ down, low @ up + high @ down
            fits = ((top >= floor[:, None]) & (bottom <= upper[:, None])).any(axis=0)
            fits &= (least <= label) & (most >= label) if same else (least != label) | (most != label)
            return [(-t, x) for t, x in zip(top[fits].tolist(), at[fits].tolist())]

        n, read = len(self.low), 0
        queue = boxes(self.group_low, self.group_high, self.group_least, self.group_most, np.arange(len(self.group_low)) + n)
        heapq.heapify(queue)
        while queue:
            top, node = heapq.heappop(queue)
            if -top < floor.min():
                break  # all boxes left end below every window's k-th score
            if node >= n:
                part = slice((node - n) * FAN, min((node - n + 1) * FAN, n))
                for x in boxes(self.low[part], self.high[part], self.least[part], self.most[part], np.arange(part.start, part.stop)):
                    heapq.heappush(queue, x)
                continue
            read += 1
            a, z = self.edge[node], self.edge[node + 1]
            score = self.v[a:z] @ q
            fits = (score >= floor[:, None]) & (score <= upper[:, None])
            fits &= ((self.label[a:z] == label) & (self.row[a:z] != own)) if same else self.label[a:z] != label
            for w in np.flatnonzero(fits.any(axis=1)).tolist():
                i = np.flatnonzero(fits[w])
                best = found[w] + list(zip((-score[i].astype(np.int64)).tolist(), self.id[a + i].tolist(), self.row[a + i].tolist()))
                best.sort()
                found[w] = best[:k]
                if len(best) >= k:
                    floor[w] = -found[w][-1][0]
        return found, read


def _searching(k: int, same: bool):
    """Kernel of a tile; a query has ``lows`` and ``highs``, its windows of scores, or none where all scores count."""
    def kernel(tile: pa.Table) -> pa.Table:
        kind = tile["kind"].to_numpy()
        blocks, queries = tile.filter(pa.array(kind == 0)), tile.filter(pa.array(kind == 1))
        out: list[tuple[int, ...]] = []
        if len(blocks) and len(queries):
            dim = queries["dim"][0].as_py()
            vectors = np.frombuffer(b"".join(queries["q"].to_pylist()), "<i4").reshape(-1, dim)
            tree = Tree(blocks, dim, int(np.abs(vectors).max()))
            lows, highs = (queries[c].to_pylist() if c in queries.column_names else [[w]] * len(queries) for c, w in (("lows", -ANY), ("highs", ANY)))
            for i, (row, key, label) in enumerate(zip(*(queries[c].to_pylist() for c in ("row", "id", "label")))):
                found, _ = tree.search(vectors[i].astype(tree.v.dtype), row, label, same, list(zip(lows[i], highs[i])), k)
                out += [(row, key, w, r, x, -s) for w, best in enumerate(found) for s, x, r in best]
        columns = zip(*out) if out else [[]] * 6
        return pa.table({c: pa.array(list(x), t) for c, x, t in zip(("anchor_row", "anchor_id", "window", "row", "id", "score"), columns,
                                                                    (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})

    return kernel


def hard_negatives(df: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor, a row of ``df`` that ``anchors`` (a condition on ``id``) selects.

    Positives are the ``positives`` other rows of its label with the greatest inner product of components floor(256 x); negatives of a positive the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score. Greater scores come first, then smaller ids. Fewer are returned where there are fewer:
    none for an anchor alone in its label, and none for a negative positive score, whose window is empty. Rows without id, label or vector, with an empty vector, or with a null,
    non-finite or too large component (65,536 and more) take no part; vectors of other lengths never meet. Rows that share an id, or are equal in everything, are
    rows of their own. ``label`` must be an integer. Columns beside those named are not read.
    """
    rows = V.quantised(df, key, vector, label)
    n = max(-(-V.values(rows) // V.BLOCK_VALUES), 1)
    by = ["dim", "label", "key", "row"]
    tree = C.written(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_pack, TREE), "r-tree")
    asked = rows.filter(anchors).select("row", "id", "label", "dim", F.col("v").alias("q"))

    def best(found: DataFrame, k: int, name: str) -> DataFrame:
        order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = C.written(best(V.tiles(tree, asked, _searching(positives, True), FOUND), positives, "positive"), "positives")
    # the windows of an anchor, by rank of its positives
    least, most = F.expr(f"CAST(-floor(CAST(-{int(low)} * score AS decimal(38,0)) / 100) AS bigint)"), F.expr(f"CAST(floor(CAST({int(high)} * score AS decimal(38,0)) / 100) AS bigint)")
    windows = (near.withColumn("w", F.struct("rank", least.alias("lo"), most.alias("hi"))).groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list("w")).alias("w"))
               .select("row", F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs")))
    hard = best(V.tiles(tree, asked.join(windows, "row"), _searching(negatives, False), FOUND), negatives, "negative")
    pairs = near.select("anchor_row", F.col("anchor_id"), (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (pairs.join(hard.select("anchor_row", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_row", "window"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
