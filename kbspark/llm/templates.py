"""Lines from recurring templates, found with a parse tree of fixed depth, by DataFrame functions.

A line's leaf is its number of tokens and its leading tokens, a token with a digit standing for any. In a leaf that
enough documents reach, a token stays in the template where enough documents have it at its place, and is variable elsewhere.
Lines whose template keeps enough tokens and recurs in enough documents are dropped. A line is also a constant template of its own, with all
its tokens as they stand; the longer it is, the fewer texts make it recurring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm import common as C

ANY = "<*>"


def _spaced(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x09-\x0D ]+", " "))


def _tokens(line: Column) -> Column:
    return F.split(_spaced(line), " ")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(ANY)).otherwise(token)


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 4, min_docs: int = 10, kept_share: float = 0.5,
                         min_tokens: int = 4, constant_tokens: int = 80, short_lines: bool = False) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and ``n_lines`` and ``n_dropped``.

    ``depth`` leading tokens choose the leaf; ``min_docs`` documents make a leaf, a token's place or a template recurring; a template must keep
    ``kept_share`` of its tokens. Repeats in one document count once. A null text stays null with 0 lines,
    an empty one has one empty line. A row is told by key and text; equal rows count as one document, and so do rows of one key and text.

    A line of ``n`` tokens with the same tokens, digits too, in ``min_docs`` documents goes, and so does one in ``constant_tokens / n`` different texts,
    two at least: copies of one text don't take each other's lines. Lines under ``min_tokens`` tokens stay, unless ``short_lines`` lets them go
    by this rule for ``min_docs`` documents; lines without tokens always stay.

    Leaves and templates are counted on hashes, in each document first. Only lines of recurring leaves are cut into tokens, with their places.
    """
    extra = ("n_lines", "n_dropped")
    at, row = C.free(docs, "at"), C.free(docs, "row")
    base = docs.drop(*extra).withColumn(row, F.xxhash64(F.col(key), F.col(text)))
    lines = F.split(F.col(text), "\n")
    cut = F.transform(F.transform(lines, _spaced), lambda x: F.struct(x.alias("line"), F.split(x, " ").alias("tokens")))
    head = F.transform(cut, lambda c: F.struct(F.when(c["line"] == "", 0).otherwise(F.size(c["tokens"])).alias("n"), F.xxhash64(c["line"]).alias("whole"),
                                               F.transform(F.slice(c["tokens"], 1, depth), _masked).alias("lead")))
    known = F.transform(head, lambda h: F.struct(h["n"].alias("n"), h["whole"].alias("whole"),
                                                 F.when(h["n"] >= min_tokens, F.xxhash64(h["n"], h["lead"])).alias("leaf")))
    ids = C.written(base.filter(F.col(text).isNotNull()).select(row, F.xxhash64(F.col(text)).alias("text_id"), known.alias("known")), "line-ids")
    # documents of each leaf; a leaf of few documents can hold no recurring template
    leaves = (ids.select(row, F.explode(F.array_distinct(F.filter("known.leaf", lambda x: x.isNotNull()))).alias("leaf"))
              .groupBy("leaf").count().filter(F.col("count") >= min_docs).select("leaf"))
    leaves = C.written(leaves, "line-leaves")
    places = ids.select(row, "text_id", F.posexplode("known").alias("at", "x")).select(row, "text_id", "at", "x.n", "x.whole")
    places = places.filter(F.col("n") >= (1 if short_lines else min_tokens))
    constant = (places.groupBy("whole", "n", "text_id").agg(F.count_distinct(row).alias("docs"))
                .groupBy("whole", "n").agg(F.sum("docs").alias("docs"), F.count("*").alias("texts"))
                .filter((F.col("docs") >= min_docs) | ((F.col("n") >= min_tokens) & (F.col("texts") >= F.greatest(F.lit(2), F.ceil(F.lit(constant_tokens) / F.col("n")))))))
    constant = places.join(C.written(constant.select("whole", "n"), "line-constant"), ["whole", "n"], "left_semi").select(row, "at")
    leaf = F.transform(head, lambda h: F.when(h["n"] >= min_tokens, F.xxhash64(h["n"], h["lead"])))
    each = base.filter(F.col(text).isNotNull()).select(row, F.posexplode(F.arrays_zip(lines.alias("line"), leaf.alias("leaf"))).alias("at", "x"))
    likely = (each.filter("x.leaf IS NOT NULL").select(row, "at", F.col("x.leaf").alias("leaf"), F.col("x.line").alias("line")).join(leaves, "leaf", "left_semi"))
    # equal lines are one from here on: the line's hash stands for it
    likely = C.written(likely.select(row, "at", "leaf", F.xxhash64("line").alias("line_id"), "line"), "line-candidates")
    distinct = C.written(likely.groupBy("leaf", "line_id").agg(F.first("line").alias("line")), "line-distinct")
    tokens = distinct.select("leaf", "line_id", F.posexplode(F.transform(_tokens(F.col("line")), _masked)).alias("place", "token"))
    # documents of a token: one with a single line of the leaf counts with that line, in the others each token counts once
    own = C.written(likely.groupBy(row, "leaf").agg(F.min("line_id").alias("line_id"), F.max("line_id").alias("other")), "line-rows")
    alone = own.filter("line_id = other").groupBy("leaf", "line_id").agg(F.count("*").alias("n"))
    several = likely.join(own.filter("line_id <> other").select(row, "leaf"), [row, "leaf"], "left_semi")
    several = (several.select(row, "leaf", F.posexplode(F.transform(_tokens(F.col("line")), _masked)).alias("place", "token")).filter(F.col("token") != ANY)
               .groupBy("leaf", "place", "token").agg(F.count_distinct(row).alias("n")))
    steady = tokens.filter(F.col("token") != ANY).join(alone, ["leaf", "line_id"]).select("leaf", "place", "token", "n").unionByName(several)
    steady = steady.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).drop("n")
    shaped = (tokens.join(steady.withColumn("keep", F.lit(True)), ["leaf", "place", "token"], "left")
              .groupBy("leaf", "line_id").agg(F.avg(F.when(F.col("keep"), 1.0).otherwise(0.0)).alias("share"),
                                              F.xxhash64(F.sort_array(F.collect_list(F.when(F.col("keep"), F.struct("place", "token"))))).alias("template")))
    shaped = shaped.filter(F.col("share") >= kept_share).select("leaf", "line_id", "template")
    tagged = C.written(likely.select(row, "at", "leaf", "line_id").join(shaped, ["leaf", "line_id"]).select(row, "at", "leaf", "template"), "line-templates")
    recurring = tagged.groupBy("leaf", "template").agg(F.count_distinct(row).alias("n")).filter(F.col("n") >= min_docs).select("leaf", "template")
    drops = (tagged.join(recurring, ["leaf", "template"], "left_semi").select(row, "at").unionByName(constant)
             .groupBy(row).agg(F.collect_set("at").alias(at)))
    out = base.join(drops, row, "left")
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(at, i), F.lit(False)))
    return out.select(*[F.array_join(kept, "\n").alias(text) if c == text else F.col(c) for c in docs.drop(*extra).columns],
                      F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size(at), F.lit(0)).alias("n_dropped"))
