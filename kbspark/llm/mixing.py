"""Mixing sources to target weights by entropy balancing, by DataFrame functions.

Every document gets a rate between 0 and 2 copies. Among all rates under which each source's words meet its target, those nearest to one copy
each in entropy are wanted; they are tilted exponentials, ``2 / (1 + exp(-lambda x))`` with x the size over its source's mean. Newton iterations
solve the convex dual for the lambdas of all sources together, over a table of distinct sizes. Rates become copies by systematic rounding in
order of size, which keeps each source's words within one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C

SHARE, MOST, WEIGHTS = 1.5, 2, (3, 1, 2)
#: Documents of one source and size that are numbered in one group.
CELL = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in order of code point, null last, weigh ``weights`` in turn. They share ``share`` of all words by weight; a target stops at ``most``
    times its source's words, and what is over is shared again by weight. So a level is sought at which capped and uncapped targets sum up:
    sources are capped in order of cap by weight as long as the level of the others stays above theirs. Sources without words get 0.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    upto = everything.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    w = (w.withColumn("all", F.sum("source_size").over(everything) * F.lit(share)).withColumn("w_all", F.sum("w").over(everything))
         .withColumn("cap_to", F.sum("cap").over(upto)).withColumn("w_to", F.sum("w").over(upto)))
    # a source is capped if, with all of smaller or equal ratio at their caps, the others' level is at least its ratio
    w = w.withColumn("capped", F.col("all") - F.col("cap_to") >= F.col("ratio") * (F.col("w_all") - F.col("w_to")) * (1 - 1e-12))
    level = (F.max("all").over(everything) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / \
        F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def balance(cells: DataFrame, goals: DataFrame, iterations: int = 60) -> DataFrame:
    """(source, lambda) from (source, x, size, n) and (source, target, source_size): Newton steps on the dual of every source at once.

    A step is the gap in words over the slope, held back to 4; it stops when every gap is below a ten-thousandth of its target, and raises if none of ``iterations`` steps gets there.
    A source at its cap takes all rates as 2 and one without words or target all as 0; neither takes part.
    """
    goals = goals.filter((F.col("target") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-9)))
    now = goals.select("source", "target", F.lit(0.0).alias("lambda"))
    cells = cells.filter("size > 0")
    for step in range(iterations):
        rate = 2 / (1 + F.exp(-F.col("lambda") * F.col("x")))
        seen = (cells.join(now, cells["source"].eqNullSafe(now["source"])).select(now["source"].alias("source"), "target", "lambda", "n", "size", "x", rate.alias("r"))
                .groupBy("source", "target", "lambda").agg(F.sum(F.col("n") * F.col("size") * F.col("r")).alias("words"),
                                                            F.sum(F.col("n") * F.col("size") * F.col("x") * F.col("r") * (2 - F.col("r")) / 2).alias("slope")))
        move = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col("target") - F.col("words")) / F.greatest("slope", F.lit(1e-9))))
        new = seen.select("source", "target", (F.col("lambda") + move).alias("lambda"), (F.abs(F.col("target") - F.col("words")) / F.col("target")).alias("gap"))
        new = C.written(new, "mix-lambda")
        worst = new.agg(F.max("gap")).first()[0]
        now = new.drop("gap")
        if worst is None or worst < 1e-4:
            return now.select("source", "lambda")
    if goals.count():
        raise RuntimeError(f"the mix is off by {worst:.2g} of a target after {iterations} steps")
    return now.select("source", "lambda")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, most: int = MOST,
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Key, ``size`` (words), ``source_size``, ``target`` and ``copies`` (0 to 2) of each row of ``docs``.

    A null text has no words; a document without words is worth nothing to a target and gets one copy. A null source is a source of its own.
    Which documents of equal source and size get the extra copy is decided by a hash of key and text, so reruns agree; equal rows are interchangeable.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    rows = C.written(rows, "mix-sizes")
    counts = C.written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    per_source = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("bigint").alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_docs"))
    goals = C.written(targets(per_source.select("source", "source_size"), share, most, weights), "mix-targets")
    mean = per_source.select(F.col("source").alias("s"), (F.col("source_size") / F.col("n_docs")).alias("mean"))
    cells = counts.join(mean, counts["source"].eqNullSafe(mean["s"])).select("source", "size", "n", (F.col("size") / F.col("mean")).alias("x"))
    lambdas = balance(cells, goals).select(F.col("source").alias("s"), "lambda")
    # documents of one source and size beyond CELL are numbered in several groups
    cells = cells.withColumn("groups", F.ceil(F.col("n") / CELL).cast("int"))
    rate = (F.when(F.col("size") == 0, 1.0).when(F.col("lambda").isNotNull(), 2 / (1 + F.exp(-F.col("lambda") * F.col("x"))))
            .when(F.col("target") > 0, 2.0).otherwise(0.0))
    g = goals.select(F.col("source").alias("s"), "source_size", "target")
    rated = cells.join(g, cells["source"].eqNullSafe(g["s"])).drop("s")
    rated = rated.join(lambdas, rated["source"].eqNullSafe(lambdas["s"]), "left").select("source", "size", "groups", "source_size", "target", rate.alias("rate"))
    rated = C.written(rated, "mix-rates")
    r = rated.withColumnRenamed("source", "s").withColumnRenamed("size", "z")
    placed = (rows.join(r, rows["source"].eqNullSafe(r["s"]) & (rows["size"] == r["z"])).drop("s", "z")
              .withColumn("grp", F.pmod("h", F.col("groups")).cast("int")))
    groups = placed.groupBy("source", "size", "grp", "rate").agg(F.count("*").alias("m"))
    along = Window.partitionBy("source").orderBy("size", "grp")
    due = F.floor(F.sum(F.col("m") * F.col("rate")).over(along) + 0.5)
    shares = groups.withColumn("due", due).withColumn("give", F.col("due") - F.coalesce(F.lag("due").over(along), F.lit(0)))
    # one copy more or less of the document whose size is nearest to what is still missing or over in its source
    gap = shares.join(g, shares["source"].eqNullSafe(g["s"])).groupBy("source").agg((F.first("target") - F.sum(F.col("give") * F.col("size"))).alias("gap"))
    gap = gap.select(F.col("source").alias("s"), "gap")
    off = F.abs(F.abs("gap") - F.col("size"))
    able = shares.join(gap, shares["source"].eqNullSafe(gap["s"])).filter(off < F.abs("gap")).filter(
        F.when(F.col("gap") > 0, F.col("give") < most * F.col("m")).otherwise(F.col("give") > 0))
    pick = able.groupBy("source").agg(F.min(F.struct(off.alias("off"), "size", "grp", F.signum("gap").cast("bigint").alias("more"))).alias("p"))
    pick = pick.select(F.col("source").alias("s"), "p.size", "p.grp", "p.more").withColumnRenamed("size", "z").withColumnRenamed("grp", "q")
    shares = (shares.join(pick, shares["source"].eqNullSafe(pick["s"]) & (shares["size"] == pick["z"]) & (shares["grp"] == pick["q"]), "left")
              .withColumn("give", F.col("give") + F.coalesce("more", F.lit(0))))
    s = shares.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("grp").alias("q"), "m", "give")
    nth = F.row_number().over(Window.partitionBy("source", "size", "grp").orderBy("h"))
    return (placed.withColumn("nth", nth).join(s, placed["source"].eqNullSafe(s["s"]) & (placed["size"] == s["z"]) & (placed["grp"] == s["q"]))
            .select(F.col("__key").alias(key), "source", "h", "size", "source_size", "target",
                    F.least(F.lit(most), F.floor(F.col("give") / F.col("m")) + (F.col("nth") <= F.pmod("give", "m")).cast("int")).cast("int").alias("copies")))
