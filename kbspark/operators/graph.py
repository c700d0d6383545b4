"""Entity graph: extraction parsing, build, view and multi-hop retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.predicates import visible_in_graph_view
from kbspark.functions.scalars import ellipsis
from kbspark.session import cut_lineage

EXTRACTION = ("struct<entities:array<struct<name:string,type:string>>,"
              "relations:array<struct<source:string,target:string,type:string>>>")


# --- building -----------------------------------------------------------------------------------

def extraction_batches(chunks: DataFrame, cap: int | None = None) -> DataFrame:
    """Fine chunks of each document in batches of 3, 5 or 8 by chunk count; with ``cap`` only the first ``cap`` chunks."""
    w = Window.partitionBy("doc_code").orderBy("chunk_index", "chunk_id")
    fine = chunks.filter(F.col("chunk_index") >= 0).withColumn("rn", F.row_number().over(w))
    if cap is not None:
        fine = fine.filter(F.col("rn") <= cap)
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_code"))
    size = F.when(F.col("n") <= 50, 3).when(F.col("n") <= 150, 5).otherwise(8)
    return fine.withColumn("n", n).withColumn("batch_no", F.floor((F.col("rn") - 1) / size).cast("int"))


def batch_texts(batched: DataFrame, sep: str = "\n---\n") -> DataFrame:
    """Text of each batch (at most eight chunks) and its chunk ids; blank batches are dropped."""
    piece = F.struct("rn", F.col("chunk_id").alias("c"), F.col("content").alias("t"))
    agg = batched.groupBy("doc_code", "batch_no").agg(F.array_sort(F.collect_list(piece)).alias("a"))
    kept = F.filter(F.transform("a", lambda x: x["t"]), lambda t: t.isNotNull())
    return (agg.select("doc_code", "batch_no", F.array_join(kept, sep).alias("text"),
                       F.transform("a", lambda x: x["c"]).alias("chunk_ids"))
            .filter(F.trim("text") != ""))


def parse_extraction(df: DataFrame, keys: list[str], json: str = "extraction", entity_type: str = "unknown",
                     relation_type: str = "related") -> tuple[DataFrame, DataFrame]:
    """Entity rows and relation rows of JSON results: trimmed, blank names dropped, types defaulted.

    Malformed text gives no rows; unknown fields are ignored.
    """
    p = df.select(*keys, F.from_json(F.col(json), EXTRACTION).alias("x"))
    e = p.select(*keys, F.posexplode("x.entities").alias("pos", "e"))
    name = F.trim("e.name")
    entities = (e.filter(F.coalesce(name, F.lit("")) != "")
                .select(*keys, "pos", name.alias("name"), F.coalesce(F.trim("e.type"), F.lit(entity_type)).alias("type")))
    r = p.select(*keys, F.posexplode("x.relations").alias("pos", "r"))
    src, dst = F.trim("r.source"), F.trim("r.target")
    relations = (r.filter((F.coalesce(src, F.lit("")) != "") & (F.coalesce(dst, F.lit("")) != ""))
                 .select(*keys, "pos", src.alias("src"), dst.alias("dst"),
                         F.coalesce(F.nullif(F.trim("r.type"), F.lit("")), F.lit(relation_type)).alias("type")))
    return entities, relations


Extractor = Callable[[str], str]


def extract(batches: DataFrame, extractor: Extractor) -> DataFrame:
    """JSON extraction of each batch text by any callable, Arrow-batched; a failed call leaves null and its error."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            done = [_attempt(extractor, t) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(extraction=[x for x, _ in done], error=[e for _, e in done])

    return batches.select("doc_code", "batch_no", "text", "chunk_ids").mapInPandas(
        run, "doc_code string, batch_no int, chunk_ids array<string>, extraction string, error string")


def _attempt(extractor: Extractor, text: str, attempts: int = 2) -> tuple[str | None, str | None]:
    """Result of the first call that succeeds, or the error of the last."""
    error = None
    for _ in range(attempts):
        try:
            return extractor(text), None
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
    return None, error


CAPITALISED = r"(?:^|[^\p{L}\p{N}])(\p{Lu}[\p{L}\p{N}]{3,})"


def phrase_extraction(batches: DataFrame, max_entities: int | None = None) -> DataFrame:
    """Default extractor: the capitalised words of a batch by frequency, each related to the next in rank; with ``max_entities`` only the first ones."""
    keys = ["doc_code", "batch_no"]
    words = batches.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(CAPITALISED), F.lit(1))).alias("w"))
    counted = words.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"))
    by_rank = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "w")
    top = counted.withColumn("r", F.row_number().over(by_rank))
    if max_entities is not None:
        top = top.filter(F.col("r") <= max_entities)
    found = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("t"))
    ents = F.transform("t", lambda w: F.struct(w.alias("name"), F.lit("term").alias("type")))
    pairs = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.struct(
        a.alias("source"), b.alias("target"), F.lit("next").alias("type")))
    return found.select(*keys, F.to_json(F.struct(ents.alias("entities"), pairs.alias("relations"))).alias("extraction"))


def merge_entities(rows: DataFrame, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """One row per name; an existing type stays, else the first writer's."""
    first = rows.groupBy("name").agg(F.min_by("type", F.struct(*order)).alias("type"))
    if existing is None:
        return first
    return existing.select("name", "type").unionByName(first.join(existing.select("name"), "name", "left_anti"))


def merge_edges(edges: DataFrame, *order: str) -> DataFrame:
    """One row per ordered pair; the last writer's type stays."""
    return edges.groupBy("src", "dst").agg(F.max_by("type", F.struct(*order)).alias("type"))


def known_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends are entities."""
    names = entities.select(F.col("name"))
    return (relations.join(names.withColumnRenamed("name", "src"), "src", "left_semi")
            .join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select(*relations.columns))


def build_graph(chunks: DataFrame, extractor: Extractor | None = None, cap: int | None = None,
                attach: str = "batch") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and relations of documents from their fine chunks, and the batches whose extraction failed.

    Extractions are written once to the checkpoint folder, and every result comes from that table, so a model is
    asked once for each batch. Failed batches come back with chunk ids and ``error``. ``attach='batch'`` ties the entities of a batch to all its chunks,
    ``'chunk'`` only to the chunks whose text holds the name.
    """
    batches = batch_texts(extraction_batches(chunks, cap))
    keys = ["doc_code", "batch_no"]
    if extractor is None:
        found = cut_lineage(phrase_extraction(batches))
        members = batches.select(*keys, F.explode("chunk_ids").alias("chunk_id"))
        failures = batches.select(*keys, "chunk_ids", F.lit("").alias("error")).filter(F.lit(False))
    else:
        found = cut_lineage(extract(batches, extractor))
        members = found.select(*keys, F.explode("chunk_ids").alias("chunk_id"))
        failures = found.filter("error IS NOT NULL").select(*keys, "chunk_ids", "error")
    ents, rels = parse_extraction(found, keys)
    order = [*keys, "pos"]
    entities = merge_entities(ents, order)
    has = ents.select(*keys).distinct()
    relations = merge_edges(known_endpoints(rels.join(has, keys, "left_semi"), entities), *order)
    mentions = ents.select(*keys, F.col("name").alias("entity_name")).distinct().join(members, keys)
    if attach == "chunk":
        mentions = (mentions.join(chunks.select("chunk_id", "content"), "chunk_id")
                    .filter(F.contains("content", F.col("entity_name"))))
    return entities, mentions.select("chunk_id", "entity_name").distinct(), relations, failures


# --- multi-hop retrieval --------------------------------------------------------------------------

def reachable(relations: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """(e1, targets): for each ``e1`` of ``starts`` the first ``limit`` entities (by name, in order) one or two directed steps away, no edge used twice in a path.

    Only edges of entities that the search has reached are kept, by a semi-join for each step. Exact under the limit: a middle node adds its
    first ``limit + 1`` targets at most, since one of them (the edge just walked, a self loop) may be barred. So a hub adds edges x limit
    rows, not in-degree x out-degree.
    """
    edges = relations.select("src", "dst")
    first = edges.join(starts.select(F.col("e1").alias("src")).distinct(), "src", "left_semi").distinct()
    middle = first.select(F.col("dst").alias("src")).distinct()
    w = Window.partitionBy("src").orderBy("dst")
    out = (edges.join(middle, "src", "left_semi").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit + 1)
           .groupBy(F.col("src").alias("mid")).agg(F.collect_list("dst").alias("targets")))
    second = (first.select(F.col("src").alias("e1"), F.col("dst").alias("mid")).join(out, "mid").select("e1", "mid", F.explode("targets").alias("e2"))
              .filter(~((F.col("e1") == F.col("mid")) & (F.col("mid") == F.col("e2")))).select("e1", "e2"))
    both = first.select(F.col("src").alias("e1"), F.col("dst").alias("e2")).unionByName(second).distinct()
    w1 = Window.partitionBy("e1").orderBy("e2")
    return (both.withColumn("r", F.row_number().over(w1)).filter(F.col("r") <= limit)
            .groupBy("e1").agg(F.array_sort(F.collect_list("e2")).alias("targets")))


# Names that the mentions are looked up in by a broadcast; more are met where the mentions of an entity come together.
FEW_NAMES = 1_000_000
# Of so few names the texts are cut before they come together: a hub among them is spread over the tasks.
HUB_NAMES = 10_000


def _text_keys(live: DataFrame) -> list[str]:
    return [c for c in ("text_id", "text_id2") if c in live.columns]


def first_other_texts(asked: DataFrame, live: DataFrame, mentions: DataFrame, limit: int, keep_empty: bool = False) -> DataFrame:
    """Rows of ``asked`` with ``others``: the first ``limit`` distinct texts (by their smallest chunk id) that mention the entity ``e2`` within ``scope``.

    ``asked`` has e2, scope and any other columns, which are kept; rows without such texts only with ``keep_empty``. ``live`` has chunk_id, tenant_code,
    system_type and text_id (with text_id2 where one column doesn't tell texts apart). Scopes: 'own|tenant|system', 'global' for tenant '0' in every system,
    and 'all' for the super tenant. Few asked entities are looked up in the mentions before these meet the chunks. Then mentions and asked rows travel once,
    by entity: a mention is counted in its scopes, the lists are cut and the asked rows take theirs where they are, so no list is shuffled.
    """
    keys, rest = _text_keys(live), [c for c in asked.columns if c not in ("e2", "scope")]
    near, names = mentions, asked.agg(F.approx_count_distinct("e2")).first()[0]
    if names <= FEW_NAMES:
        near = mentions.join(F.broadcast(asked.select(F.col("e2").alias("entity_name")).distinct()), "entity_name", "left_semi")
    home = F.when(F.col("tenant_code") == "0", F.lit("global")).otherwise(F.concat_ws("|", F.lit("own"), "tenant_code", "system_type"))
    found = (near.filter("entity_name IS NOT NULL").join(live, "chunk_id")
             .select(F.col("entity_name").alias("e2"), home.alias("scope"), *keys, F.col("chunk_id").alias("other_id")))
    if names <= min(FEW_NAMES, HUB_NAMES):  # what is among the first of all scopes is so in its own
        found = found.groupBy("e2", "scope", *keys).agg(F.min("other_id").alias("other_id"))
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("e2", "scope").orderBy("other_id", *keys))).filter(F.col("r") <= limit).drop("r")
    ask = F.struct(*(rest or [F.lit(True).alias("asked")])).alias("ask")
    both = found.unionByName(asked.filter("e2 IS NOT NULL").select("e2", "scope", ask), allowMissingColumns=True).repartition("e2")
    # all that follows is grouped by the entity first, and stays where it is
    texts = both.select("e2", F.explode(F.when(F.col("ask").isNull(), F.array("scope", F.lit("all"))).otherwise(F.array("scope"))).alias("scope"),
                        *keys, "other_id", "ask", F.col("ask").isNotNull().alias("is_ask"))
    same = Window.partitionBy("e2", "scope", "is_ask", *keys).orderBy("other_id")
    texts = texts.withColumn("r", F.row_number().over(same)).filter(F.col("is_ask") | (F.col("r") == 1))
    in_order = Window.partitionBy("e2", "scope", "is_ask").orderBy("other_id", *keys)
    texts = texts.withColumn("r", F.row_number().over(in_order)).filter(F.col("is_ask") | (F.col("r") <= limit))
    other = F.when(~F.col("is_ask"), F.struct("other_id", *keys))
    out = (texts.withColumn("others", F.array_sort(F.collect_list(other).over(Window.partitionBy("e2", "scope")))).filter("is_ask")
           .select("e2", "scope", *[F.col("ask")[c].alias(c) for c in rest], "others"))
    return out if keep_empty else out.filter(F.size("others") > 0)


# Steps of each question that are tried before the rest.
FIRST_STEPS = 6


def multi_hop(seeds: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame, limit: int = 30) -> DataFrame:
    """Paths seed chunk -> entity -> entity (1-2 steps) -> other chunk, first ``limit`` per question.

    ``seeds``: query_id, chunk_id, tenant_code, system_type. Rows are distinct on (source text, entity1, entity2, other text) and ordered by
    (seed id, entity1, entity2, other id). The search goes outward from the seeds: each step meets only the mentions, edges and chunk headers of
    what it has reached, and keeps only what can still be among the first ``limit`` rows of a question: each kept prefix yields one row or more, so
    the cuts are exact and no step grows with the size of a hub. Texts are told apart by the column ``text_id`` of a chunk store
    (by two hashes where ``chunks`` has none) and fetched at the end, by the ids of the rows that remain. A step travels as one row with its list of ids,
    not as a row for each id, until the texts are fetched.
    """
    t, s = F.col("t"), F.col("s")
    seen = ((t == "0") | ((F.col("tenant_code") == t) & (F.col("system_type") == s)) | (F.col("tenant_code") == "0"))
    # two hashes of the text with other seeds: 128 bits
    ids = [F.col("text_id")] if "text_id" in chunks.columns else [F.xxhash64("content").alias("text_id"), F.xxhash64(F.lit(1), "content").alias("text_id2")]
    live = chunks.filter("enabled").select("chunk_id", "tenant_code", "system_type", *ids)
    keys = _text_keys(live)
    q = seeds.select("query_id", "chunk_id", F.col("tenant_code").alias("t"), F.col("system_type").alias("s"))
    # of a chunk only the first ``limit`` entities can be among the first rows; they travel with it as one row
    per_chunk = Window.partitionBy("chunk_id").orderBy("e1")
    names = F.collect_set(F.struct("e1")).over(Window.partitionBy("chunk_id"))
    named = (mentions.select("chunk_id", F.col("entity_name").alias("e1")).withColumn("r", F.dense_rank().over(per_chunk)).filter(F.col("r") <= limit)
             .withColumns({"names": names, "first": F.row_number().over(per_chunk)}).filter("first = 1").select("chunk_id", "names"))
    starts = (q.join(live, "chunk_id").filter(seen).select("query_id", "t", "s", "chunk_id", *keys).join(named, "chunk_id").repartition("query_id", *keys)
              .select("query_id", "t", "s", "chunk_id", *keys, F.explode("names.e1").alias("e1"))
              .groupBy("query_id", "t", "s", *keys, "e1").agg(F.min("chunk_id").alias("source_id")).drop(*keys))
    per_q = Window.partitionBy("query_id").orderBy("source_id", "e1")  # starts of one chunk and entity are alike
    # the frontier after each step is written: the next step reads it twice, and what led to it isn't computed again
    starts = cut_lineage(starts.withColumn("r", F.row_number().over(per_q)).filter(F.col("r") <= limit))

    # A step yields a row for each text of its lists, and one at least. The first few steps fill most questions; only the others look at more.
    found, have = [], None
    for low, high in ((0, min(FIRST_STEPS, limit)), (FIRST_STEPS, limit)):
        if low >= high:
            break
        some = starts.filter(F.col("r") <= high)  # a start makes a step for each target, one at least
        if have is not None:
            unfilled = cut_lineage(have.filter(F.col("have") < limit))
            if unfilled.isEmpty():
                break
            some = some.join(unfilled, "query_id")
        else:
            some = some.withColumn("have", F.lit(0))
        sized = some.join(reachable(relations, some, limit), "e1", "left").withColumn("n", F.greatest(F.lit(1), F.coalesce(F.size("targets"), F.lit(0))))
        in_order = Window.partitionBy("query_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        sized = sized.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)).cast("int")).filter(F.col("before") < high)
        scopes = F.when(t == "0", F.array(F.lit("all"))).otherwise(F.array(F.concat_ws("|", F.lit("own"), t, s), F.lit("global")))
        steps = cut_lineage(sized.select("query_id", "have", "source_id", "e1", "before", scopes.alias("scopes"), F.posexplode_outer("targets").alias("at", "e2"))
                            .withColumn("step", F.col("before") + F.coalesce("at", F.lit(0)) + 1)
                            .filter((F.col("step") > low) & (F.col("step") <= high)).drop("before", "at"))
        cols = ["query_id", "have", "step", "source_id", "e1", "e2"]
        each = steps.filter("e2 IS NOT NULL").select(*cols, F.explode("scopes").alias("scope"))
        # the lists of a step lie in one place: they become one list of distinct texts there
        lists = first_other_texts(each, live, mentions, limit, keep_empty=True).groupBy(*cols).agg(F.collect_list("others").alias("lists"))
        both = F.array_sort(F.flatten("lists"))
        alike = lambda x: lambda y: reduce(Column.__and__, [y[k].eqNullSafe(x[k]) for k in keys])
        distinct = F.filter("both", lambda x, i: ~F.exists(F.slice("both", F.lit(1), i), alike(x)))
        told = (lists.withColumn("both", both).withColumn("both", F.when(F.size("lists") > 1, distinct).otherwise(F.col("both")))
                .select(*cols, F.transform(F.slice("both", 1, limit), lambda x: x["other_id"]).alias("others")))
        told = told.unionByName(steps.filter("e2 IS NULL").select(*cols), allowMissingColumns=True)
        n = F.greatest(F.lit(1), F.coalesce(F.size("others"), F.lit(0)))
        earlier = Window.partitionBy("query_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        told = told.withColumn("base", (F.col("have") + F.coalesce(F.sum(n).over(earlier), F.lit(0))).cast("int")).filter(F.col("base") < limit)
        found.append(cut_lineage(told.select("query_id", "base", "source_id", "e1", "e2", F.slice("others", F.lit(1), F.lit(limit) - F.col("base")).alias("others"))))
        have = found[-1].groupBy("query_id").agg(F.max(F.col("base") + n).alias("have"))
    rows = reduce(DataFrame.unionByName, found)
    # the only place where texts are read: all ids of a step, its source in front with what belongs to the step, meet the chunks in one join
    place = F.col("base") * (limit + 1)
    step = F.struct("e1", "e2", (F.coalesce(F.size("others"), F.lit(0)) < 1).alias("alone"))
    source = F.array(F.struct(place.alias("place"), F.col("source_id").alias("chunk_id"), step.alias("step")))
    others = F.transform(F.coalesce("others", F.array().cast("array<string>")),
                         lambda x, i: F.struct((place + i + 1).alias("place"), x.alias("chunk_id"), F.lit(None).cast("struct<e1:string,e2:string,alone:boolean>").alias("step")))
    ids = rows.select("query_id", F.inline(F.concat(source, others)))
    texts = ids.join(chunks.filter("enabled").select("chunk_id", "content"), "chunk_id").drop("chunk_id")
    in_order = Window.partitionBy("query_id").orderBy("place", F.col("content").desc_nulls_last())
    again = F.coalesce(F.lag("place").over(in_order) == F.col("place"), F.lit(False))  # of an id that repeats the largest text counts
    texts = texts.withColumn("again", again).filter(~F.col("again"))
    head = F.last(F.when(F.col("step").isNotNull(), F.struct("step", "content")), ignorenulls=True).over(Window.partitionBy("query_id").orderBy("place"))
    at, base = F.col("place") % (limit + 1), (F.col("place") / (limit + 1)).cast("int")
    return (texts.withColumn("head", head).filter((at > 0) | F.col("step.alone"))
            .select("query_id", (base + F.greatest(at, F.lit(1))).alias("rank"), F.col("head.content").alias("source_content"),
                    F.col("head.step.e1").alias("entity1"), F.col("head.step.e2").alias("entity2"), F.when(at > 0, F.col("content")).alias("other_content")))


# --- graph view -----------------------------------------------------------------------------------

def visible_relations(relations: DataFrame, mentions: DataFrame, chunks: DataFrame, tenant: str | None,
                      system: str | None) -> DataFrame:
    """Relations with an end mentioned by an own or global chunk, and, with a system, an end mentioned in it.

    Each entity gets both flags in one aggregation; the two ends then look them up.
    """
    any_tenant = tenant is None or tenant == "0"
    if any_tenant and system is None:
        return relations
    own = F.lit(True) if any_tenant else F.col("tenant_code").isin(tenant, "0")
    inside = F.lit(True) if system is None else F.col("system_type") == system
    flags = (mentions.join(chunks.select("chunk_id", "tenant_code", "system_type"), "chunk_id").groupBy("entity_name")
             .agg(F.max(own).alias("own"), F.max(inside).alias("inside")))

    def end(name: str) -> DataFrame:
        return flags.select(F.col("entity_name").alias(name), F.col("own").alias(f"{name}_own"), F.col("inside").alias(f"{name}_inside"))

    def either(flag: str) -> Column:
        return F.coalesce(F.col(f"src_{flag}"), F.lit(False)) | F.coalesce(F.col(f"dst_{flag}"), F.lit(False))

    found = relations.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    cond = (F.lit(True) if any_tenant else either("own")) & (F.lit(True) if system is None else either("inside"))
    return found.filter(cond).select(*relations.columns)


def graph_view(chunks: DataFrame, mentions: DataFrame, entities: DataFrame, relations: DataFrame, tenant: str | None = None,
               system: str | None = None, limit: int | None = None, unnamed: str = "chunk", unknown: str = "unknown",
               mention_label: str = "mentions") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the visible mention rows and relations; with ``limit`` of the first ones of each."""
    def first(df: DataFrame, *order: str) -> DataFrame:
        return df if limit is None else df.orderBy(*order).limit(limit)

    seen = chunks.filter(visible_in_graph_view(tenant, system)).select("chunk_id", "file_name", "content", "chunk_index")
    m = (first(mentions.join(seen, "chunk_id"), "chunk_id", "entity_name")
         .join(entities.select(F.col("name").alias("entity_name"), "type"), "entity_name", "left"))
    r = first(visible_relations(relations, mentions, chunks, tenant, system), "src", "dst")
    cid, eid = (lambda c: F.concat(F.lit("chunk_"), c)), (lambda c: F.concat(F.lit("entity_"), c))
    none = F.lit(None).cast("string")

    def node(ident, label, group, kind, title, pri):
        return F.struct(ident.alias("id"), label.alias("label"), F.lit(group).alias("group"), kind.alias("type"), title.alias("title"), F.lit(pri).alias("pri"))

    label = F.concat_ws("#", F.coalesce("file_name", F.lit(unnamed)), F.coalesce(F.col("chunk_index").cast("string"), F.lit("")))
    of_mention = F.array(node(cid(F.col("chunk_id")), label, "chunk", none, ellipsis("content", 60), 0),
                         node(eid(F.col("entity_name")), F.col("entity_name"), "entity", F.coalesce("type", F.lit(unknown)), none, 0))
    of_relation = F.array(*[node(eid(F.col(c)), F.col(c), "entity", F.lit(unknown), none, 1) for c in ("src", "dst")])
    nodes = merge_nodes(m.select(F.inline(of_mention)).unionByName(r.select(F.inline(of_relation))))
    edges = (m.select(cid(F.col("chunk_id")).alias("from"), eid(F.col("entity_name")).alias("to"), F.lit(mention_label).alias("label"))
             .unionByName(r.select(eid(F.col("src")).alias("from"), eid(F.col("dst")).alias("to"),
                                   F.coalesce("type", F.lit("related")).alias("label"))))
    return nodes, edges


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id; rows of lower ``pri`` win."""
    cols = [c for c in nodes.columns if c not in ("id", "pri")]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("pri", *cols)).alias("n")).select("id", "n.*")
