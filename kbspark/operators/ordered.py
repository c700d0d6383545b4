"""Ordered per-key computations that do not push a whole key through one task.

A plain window over ``key`` sends all rows of the key to one task, which is best for small keys. Keys of more than ``HOT_ROWS`` rows
are cut into ordered buckets: the buckets (one row each) are combined with a window and the rest is done inside the bucket, so such a key is spread over as many tasks
as it has buckets. The cuts are rows sampled from the key itself, compared by the whole order, so rows of one instant are cut too.

What a bucket needs from its neighbours travels as marker rows that sort before (``__at`` 0) or after (``__at`` 2) the bucket's own rows and are dropped
at the end. So the rows themselves are shuffled once, by (key, bucket). Rows are counted by key first; where no key is hot, a plain window is all that
is planned. Callers that chain several computations over one key and order count once (``hot_keys``) and pass the result on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kbspark.session import cut_lineage

# Rows one task takes for a key without cutting it.
HOT_ROWS = 1_000_000
# Rows sampled as possible cuts of HOT_ROWS rows, and cuts of one key at most.
SAMPLES, MOST_CUTS, COARSE = 64, 1024, 32
# Cuts that may be sent to every task; beyond that the few hot keys are joined like any table.
SENT_CUTS = 200_000
_B, _AT = "__bucket", "__at"

Order = Sequence[Column | str]


def hot_keys(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame | None:
    """Keys of more than ``HOT_ROWS`` rows with their cuts, written once; none where no key is that large."""
    names = [F.col(k).alias("__k_" + k) for k in keys]
    large = cut_lineage(df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS).drop("__n"))
    n = large.count()
    if not n:
        return None
    same = [F.col(k).eqNullSafe(F.col("__k_" + k)) for k in keys]
    chance = F.pmod(F.xxhash64(*keys, *order), F.lit(max(HOT_ROWS, 1))) < SAMPLES
    # n keys of HOT_ROWS rows or more each: the join sends a bounded list, and only sampled rows are gathered
    picked = df.filter(chance).join(F.broadcast(large) if n * MOST_CUTS <= SENT_CUTS else large, same).select(*["__k_" + k for k in keys], F.struct(*order).alias("x"))
    step = F.ceil(F.size("c") / F.lit(MOST_CUTS))
    thin = F.filter("c", lambda x, i: F.pmod(i, step) == 0)
    # a large key of which no row was sampled stays whole, as any other key
    out = (picked.groupBy(*["__k_" + k for k in keys]).agg(F.array_sort(F.collect_set("x")).alias("c")).select(*["__k_" + k for k in keys], thin.alias("__cuts")))
    return cut_lineage(out.withColumn("__heads", F.filter("__cuts", lambda x, i: i % COARSE == 0)))


def _bucketed(df: DataFrame, keys: Sequence[str], order: Order, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with a bucket where their key is hot (null elsewhere), and the rows of the hot keys."""
    size = hot.agg(F.sum(F.size("__cuts"))).first()[0] or 0
    x = F.struct(*order)
    # which group of cuts, then which of the group
    group = F.size(F.filter("__heads", lambda c: c <= x))
    inside = F.size(F.filter(F.slice("__cuts", F.greatest(group - 1, F.lit(0)) * COARSE + 1, COARSE), lambda c: c <= x))
    bucket = F.when(F.col("__hot"), F.coalesce(F.greatest(group - 1, F.lit(0)) * COARSE + inside, F.lit(0)))
    hot = hot.withColumn("__hot", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col("__k_" + k)) for k in keys]
    out = (df.join(F.broadcast(hot) if size <= SENT_CUTS else hot, same, "left").withColumn(_B, bucket)
           .drop(*["__k_" + k for k in keys], "__cuts", "__heads"))
    return out.drop("__hot"), out.filter("__hot").drop("__hot")


def _marked(df: DataFrame, *markers: DataFrame) -> DataFrame:
    out = df.withColumn(_AT, F.lit(1))
    for m in markers:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def _inside(keys: Sequence[str], order: Order) -> WindowSpec:
    return Window.partitionBy(*keys, _B).orderBy(_AT, *order)


def _plain(keys: Sequence[str], order: Order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _own(df: DataFrame, *drop: str) -> DataFrame:
    return df.filter(F.col(_AT) == 1).drop(_B, _AT, *drop)


def running_sum(df: DataFrame, keys: Sequence[str], order: Order, values: dict[str, Column], inclusive: bool = True, hot: DataFrame | None | bool = True) -> DataFrame:
    """Running sums in ``order`` within ``keys``; exclusive sums start at 0."""
    hot = hot_keys(df, keys, order) if hot is True else hot
    upto = 0 if inclusive else -1
    if hot is None:
        frame = _plain(keys, order).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumns({n: F.coalesce(F.sum(v).over(frame), F.lit(0)) for n, v in values.items()})
    names = {n: f"__v_{n}" for n in values}
    df, rows = _bucketed(df.withColumns({names[n]: v for n, v in values.items()}), keys, order, hot)
    sums = rows.groupBy(*keys, _B).agg(*[F.sum(c).alias(c) for c in names.values()])
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, _B, F.lit(0).alias(_AT), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c)
                                                            for c in names.values()])
    frame = _inside(keys, order).rowsBetween(Window.unboundedPreceding, upto)
    out = _marked(df, offsets).withColumns({n: F.coalesce(F.sum(c).over(frame), F.lit(0)) for n, c in names.items()})
    return _own(out, *names.values())


def row_numbers(df: DataFrame, keys: Sequence[str], order: Order, out: str, hot: DataFrame | None | bool = True) -> DataFrame:
    return running_sum(df, keys, order, {out: F.lit(1).cast("bigint")}, hot=hot)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, inclusive: bool = True, hot: DataFrame | None | bool = True) -> DataFrame:
    """Last non-null ``value`` up to the row (or strictly before it)."""
    hot = hot_keys(df, keys, order) if hot is True else hot
    upto = 0 if inclusive else -1
    if hot is None:
        frame = _plain(keys, order).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumn("__v", value).withColumn(out, F.last("__v", ignorenulls=True).over(frame)).drop("__v")
    df, rows = _bucketed(df.withColumn("__v", value), keys, order, hot)
    lasts = rows.groupBy(*keys, _B).agg(
        F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__v"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, _B, F.lit(0).alias(_AT), F.last("__v", ignorenulls=True).over(before).alias("__v"))
    frame = _inside(keys, order).rowsBetween(Window.unboundedPreceding, upto)
    return _own(_marked(df, carried).withColumn(out, F.last("__v", ignorenulls=True).over(frame)), "__v")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, prev: str | None = None, nxt: str | None = None,
               hot: DataFrame | None | bool = True) -> DataFrame:
    """Value of the previous and next row in ``order`` within ``keys``."""
    hot = hot_keys(df, keys, order) if hot is True else hot
    steps = [(name, step) for name, step in ((prev, F.lag), (nxt, F.lead)) if name]
    if hot is None:
        return df.withColumns({name: step(value).over(_plain(keys, order)) for name, step in steps})
    df, rows = _bucketed(df, keys, order, hot)
    edges = rows.groupBy(*keys, _B).agg(F.min_by(value, F.struct(*order)).alias("__first"),
                                       F.max_by(value, F.struct(*order)).alias("__last"))
    w = Window.partitionBy(*keys).orderBy(_B)
    edges = edges.select(*keys, _B, F.lag("__last").over(w).alias("__p"), F.lead("__first").over(w).alias("__n"))
    ends = F.array(F.struct(F.lit(0).alias(_AT), F.col("__p").alias(value)), F.struct(F.lit(2).alias(_AT), F.col("__n").alias(value)))
    inside = _inside(keys, order)
    return _own(_marked(df, edges.select(*keys, _B, F.inline(ends))).withColumns({name: step(value).over(inside) for name, step in steps}))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], advance: Callable[[DataFrame, WindowSpec], DataFrame], step: dict[str, Column], entry: dict[str, Column],
         hot: DataFrame | None | bool = True) -> DataFrame:
    """An associative scan: each row is a step that changes a state, and a stretch of rows is a step again.

    ``advance`` adds the state after each row by running windows over the window given, which begins with a fresh state. ``step`` says, by columns of a stretch's
    last row, which single step stands for the stretch; ``entry`` which step brings a state (of the columns ``advance`` adds) about from a fresh one. Both are named like
    the columns that ``advance`` reads.
    """
    hot = hot_keys(df, keys, order) if hot is True else hot
    if hot is None:
        return advance(df, _plain(keys, order))
    marked, rows = _bucketed(df, keys, order, hot)
    inside = Window.partitionBy(*keys, _B).orderBy(*order)
    done = advance(rows, inside).select(*keys, _B, F.struct(*order).alias("__o"), *[c.alias(n) for n, c in step.items()])
    ends = done.groupBy(*keys, _B).agg(F.max_by(F.struct(*step), "__o").alias("__s")).select(*keys, _B, "__s.*")
    through = advance(ends, Window.partitionBy(*keys).orderBy(_B))
    before = Window.partitionBy(*keys).orderBy(_B)
    state = through.select(*keys, _B, *[F.lag(c).over(before).alias(n) for n, c in entry.items()], F.row_number().over(before).alias("__nth"))
    markers = state.filter("__nth > 1").drop("__nth").withColumn(_AT, F.lit(0))
    return _own(advance(_marked(marked, markers), _inside(keys, order)))
