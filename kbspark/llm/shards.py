"""A uniform shuffle of all rows into shards of exact sizes, by DataFrame functions.

Rows fall into logical partitions by hash. A communication matrix says how many rows of each partition go to each shard;
its rows are drawn from the multivariate hypergeometric distribution, as a uniform permutation of all rows would have them. Each
partition numbers its rows in random order and deals them out by its row of the matrix; each shard then orders its rows at random again.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C

#: Logical partitions: one for each so many rows, and at most so many (the matrix is drawn in the driver).
ROWS_PER_PART, MOST_PARTS = 20_000, 1 << 14


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` out of ``good + bad`` without replacement, by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            return mode
    return mode


def communication_matrix(parts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; columns sum to shard sizes that are at most one apart, the first shards being larger."""
    rng, total = random.Random(seed), sum(parts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in parts:
        row, left, pool = [], size, sum(room)
        for s in range(shards):
            k = hypergeometric(rng, room[s], pool - room[s], left)
            pool -= room[s]
            room[s] -= k
            left -= k
            row.append(k)
        matrix.append(row)
    return matrix


def shard(rows: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = 8) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard), columns of these names replaced.

    The order is that of hashes of key, text and ``seed``, so reruns and retried tasks agree; equal rows are interchangeable. Null keys
    and texts are hashed as such. An empty table gives an empty one. The windows hold a logical partition or a part of a shard, never a whole shard.
    """
    spark = rows.sparkSession
    k, part, ends, rank, place, offset = (C.free(rows, x) for x in ("k", "part", "ends", "rank", "slot", "offset"))
    base = rows.drop("shard", "slot").withColumn(k, F.xxhash64(F.lit(seed), rows[key], rows[text]))
    n = rows.count()
    many = min(max(1, n // ROWS_PER_PART), MOST_PARTS)
    base = base.withColumn(part, F.pmod(F.xxhash64(k, F.lit(1)), F.lit(many)).cast("int"))
    counts = {r[0]: r[1] for r in base.groupBy(part).count().collect()}  # one row for each logical partition
    matrix = communication_matrix([counts.get(p, 0) for p in range(many)], shards, seed)
    # where each shard's run ends in a partition's random order: one number a shard for each logical partition
    ends_of = spark.createDataFrame([(p, [sum(row[:s + 1]) for s in range(shards)]) for p, row in enumerate(matrix)], f"{part} int, {ends} array<bigint>")
    local = Window.partitionBy(part).orderBy(F.xxhash64(k, F.lit(2)), k)
    dealt = (base.withColumn(rank, F.row_number().over(local) - 1).join(ends_of, part)
             .withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(rank)))).drop(ends, rank, part))
    # second permutation: random parts of each shard, random order in each part
    parts = min(max(1, n // shards // ROWS_PER_PART), MOST_PARTS)
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64(k, F.lit(3)), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("shard", part).count()
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    inner = Window.partitionBy("shard", part).orderBy(F.xxhash64(k, F.lit(4)), k)
    return (dealt.withColumn(place, F.row_number().over(inner) - 1).join(offsets, ["shard", part])
            .withColumn("slot", (F.col(place) + F.col(offset)).cast("bigint"))
            .select(*[c for c in rows.columns if c not in ("shard", "slot")], "shard", "slot"))
