"""Ordered pages and sort builders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.predicates import snake_case


@dataclass(frozen=True)
class Order:
    """One sort key of a request."""

    prop: str
    ascending: bool = True
    ignore_case: bool = False


# Computed sort keys a request may name.
COMPUTED_KEYS: dict[str, Column | str] = {"totalCost": "output_cost_e8 + input_cost_e8"}
JSON_ROOTS = ("extend", "data")


def sort_columns(orders: Sequence[Order]) -> list[Column]:
    """Sort keys: snake-cased columns, JSON paths below ``extend``/``data``, nulls first ascending."""
    out = []
    for o in orders:
        root, _, path = o.prop.partition(".")
        if o.prop in COMPUTED_KEYS:
            c = F.expr(COMPUTED_KEYS[o.prop])
        elif path and root in JSON_ROOTS:
            c = F.get_json_object(F.col(root), f"$.{path}")
        else:
            c = F.col(snake_case(o.prop))
        if o.ignore_case:
            c = F.lower(c)
        out.append(c.asc_nulls_first() if o.ascending else c.desc_nulls_last())
    return out


def page(df: DataFrame, orders: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page in a total order; a top-k plan, never a full sort."""
    return df.orderBy(*orders).offset(number * size).limit(size)


def page_with_total(df: DataFrame, orders: Sequence[Column], number: int, size: int) -> DataFrame:
    """The page with ``total_elements`` and ``total_pages`` as scalar subqueries on each row."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (page(df, orders, number, size)
            .withColumn("total_elements", total)
            .withColumn("total_pages", page_count(F.col("total_elements"), size)))


def page_count(total: Column, size: int) -> Column:
    return F.lit(0).cast("bigint") if size == 0 else F.ceil(total / F.lit(size)).cast("bigint")


@dataclass(frozen=True)
class Key:
    """One column of a total order; nulls stand first ascending and last descending unless said otherwise."""

    column: str
    ascending: bool = True
    nulls_first: bool | None = None

    @property
    def nulls_lead(self) -> bool:
        return self.ascending if self.nulls_first is None else self.nulls_first

    def sort(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_lead else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_lead else c.desc_nulls_last()

    def after(self, value: object) -> Column:
        """Whether a row stands strictly behind ``value`` by this column alone."""
        c = F.col(self.column)
        if value is None:
            return c.isNotNull() if self.nulls_lead else F.lit(False)
        beyond = c > F.lit(value) if self.ascending else c < F.lit(value)
        return F.coalesce(beyond, F.lit(False)) if self.nulls_lead else F.coalesce(beyond, F.lit(True))


def rows_after(keys: Sequence[Key], last: Sequence[object]) -> Column:
    """Whether a row stands behind the row with the values ``last`` in the order of ``keys``."""
    out, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, last, strict=True):
        out = out | (same & key.after(value))
        same = same & F.col(key.column).eqNullSafe(F.lit(value))
    # what the first column alone says is a predicate that a scan can use
    first = keys[0]
    if last[0] is None:
        return out
    c = F.col(first.column)
    near = c >= F.lit(last[0]) if first.ascending else c <= F.lit(last[0])
    return (near if first.nulls_lead else near | c.isNull()) & out


def next_page(df: DataFrame, keys: Sequence[Key], last: Sequence[object] | None, size: int) -> DataFrame:
    """Keyset page: the first ``size`` rows behind the row with the values ``last`` (from the start where there is none); earlier pages are not sorted or passed over."""
    rows = df if last is None else df.filter(rows_after(keys, last))
    return rows.orderBy(*[k.sort() for k in keys]).limit(size)


class PageIndex:
    """Rows in ranges of a total order, with the number of rows before each, for jumps to any page.

    Ranges are cut at sampled values and written sorted, a folder each; a jump reads the folders that its page lies in, one as a rule. Several
    pages, and deep ones, cost the same. ``keys`` must tell all rows apart, else equal rows may come in any order.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[Key]):
        self.spark, self.path, self.keys = spark, path, tuple(keys)

    @classmethod
    def build(cls, df: DataFrame, keys: Sequence[Key], path: str, rows_per_range: int = 100_000) -> PageIndex:
        order = [k.sort() for k in keys]
        ranges = max(1, -(-df.count() // rows_per_range))
        (df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
         .write.partitionBy("range").parquet(path))
        index = cls(df.sparkSession, path, keys)
        index.read().groupBy("range").count().coalesce(1).write.parquet(f"{path}/_counts")
        return index

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def counts(self) -> list[tuple[int, int]]:
        """(range, rows) in order; one row for each range."""
        return sorted((r["range"], r["count"]) for r in self.spark.read.parquet(f"{self.path}/_counts").collect())

    def jump(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) of ``size`` rows; a page beyond the end is empty."""
        want, before, chosen, skip = number * size, 0, [], 0
        for name, n in self.counts():
            if before + n > want and before < want + size:
                skip = want - before if not chosen else skip
                chosen.append(name)
            before += n
        rows = self.read().filter(F.col("range").isin(chosen) if chosen else F.lit(False)).drop("range")
        return rows.orderBy(*[k.sort() for k in self.keys]).offset(max(skip, 0)).limit(size)


def top_scored(df: DataFrame, n: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc()).limit(n)


def own_tenant_first(tenant: Column, doc_tenant: Column) -> Column:
    """0 for the asker's own documents, 1 for others; tenant '0' does not reorder."""
    return F.when(tenant == "0", 0).when(doc_tenant == tenant, 0).otherwise(1)
