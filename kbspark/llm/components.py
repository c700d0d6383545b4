"""Connected components of an undirected graph by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm import common as C


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches; nodes without an edge are not listed.

    A large star hangs the larger neighbours of each node on the smallest of its neighbourhood, a small star the
    smaller ones. Edges stay as many as nodes at most, and the rounds grow with the logarithm of the nodes. Each round is written to the shared folder.
    """
    current = C.written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct(), "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        top = both.groupBy("lo").agg(F.min("hi").alias("m")).select(F.col("lo").alias("u"), F.least("lo", "m").alias("m"))
        # large star: larger neighbours of u go to m
        large = both.filter("hi > lo").join(top, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi").filter("lo < hi").distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").filter("m < lo").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .unionByName(least.select(F.col("m").alias("lo"), "hi"))).distinct()
        new = C.written(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, current = state, new
    return new.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        new.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
