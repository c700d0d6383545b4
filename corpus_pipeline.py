"""Corpus pipeline: language, near copies, benchmark leaks, mix of sources, shards. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.llm import decontaminate, jaccard, language, mixing, shards
from kbspark.sources.tables import read_table

#: A document without letters, or with less than this share of them in its main language, is rejected.
LEAST_SHARE = 0.4
#: Rows of whole documents that travel to Python at once.
BATCH = 1 << 10
#: Cells in which equal rows are dealt their copies.
EQUAL_CELLS = 256


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has one main language."""
    with C.small_batches(spark, BATCH):
        model = language.fit(docs.filter(~C.held_out()))
    # whole rows travel as one column, so no column of theirs meets one of the operator's
    kept = language.identify(docs.select(F.struct(*docs.columns).alias("doc")), model, "doc.text", spans=False)
    return C.written(kept.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("doc.*"), "pipeline-language", BATCH)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id. Documents without words or id stay, and so do all rows of an id that stays."""
    groups = jaccard.near_copies(docs)
    out = groups.filter("n_shingles > 0 AND doc_id <> component_id").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return C.written(decontaminate.without_benchmark(docs, read_table(spark, sf_dir, "benchmark")), "pipeline-clean", BATCH)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times. Rows with the same id and text are interchangeable: together they come as often as the mix takes them."""
    copies = (mixing.mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hash"))
              .agg(F.sum("copies").alias("copies"), F.count("*").alias("equal")).filter("copies > 0"))
    # equal rows are dealt out in salted cells, as there may be any number of them; each has its place in the table that the stage before wrote
    own = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.xxhash64("doc_id", "text").alias("h"), F.pmod(F.monotonically_increasing_id(), F.lit(EQUAL_CELLS)).alias("salt"))
    rows = own.join(copies, own["doc_id"].eqNullSafe(copies["id"]) & (own["h"] == copies["hash"]))
    several = rows.filter("equal > 1")
    along = Window.partitionBy("id", "hash").orderBy("salt")
    due = F.floor(F.sum("m").over(along) * F.col("rest") / F.col("equal"))
    more = (several.groupBy("id", "hash", "salt").agg(F.count("*").alias("m"), F.first(F.col("copies") % F.col("equal")).alias("rest"), F.first("equal").alias("equal"))
            .withColumn("due", due).select(F.col("id").alias("i"), F.col("hash").alias("j"), F.col("salt").alias("k"), (F.col("due") - F.coalesce(F.lag("due").over(along), F.lit(0))).alias("more")))
    dealt = (several.withColumn("nth", F.row_number().over(Window.partitionBy("id", "hash", "salt").orderBy("equal")))
             .join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("j")) & (F.col("salt") == F.col("k")))
             .select("doc", (F.floor(F.col("copies") / F.col("equal")) + (F.col("nth") <= F.col("more")).cast("bigint")).alias("copies")))
    taken = rows.filter("equal = 1").select("doc", "copies").unionByName(dealt).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot in a uniform order."""
    return shards.shard(docs)


STAGES = [("language_id", identify_language), ("jaccard_join", drop_near_copies), ("decontamination", drop_benchmark_leaks),
          ("mixing", mix_sources), ("sharding", assign_shards)]

#: No SQL: SQL can't express the trained language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
