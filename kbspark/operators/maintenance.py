"""Document life cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import scalars
from kbspark.operators import ordered
from kbspark.session import cut_lineage

SOURCES_SCHEMA = ("array<struct<fileName:string,title:string,docCode:string,tenantCode:string,chunkIndex:string,"
                  "pageNumber:string,titleHierarchy:string,content:string,deleted:boolean>>")


def admission_reason(name: str | Column, size: str | Column, max_size: int,
                     formats: Sequence[str] = scalars.SUPPORTED_FORMATS) -> Column:
    """Why a file is refused, null when it is accepted; the first failing rule counts."""
    n = F.col(name) if isinstance(name, str) else name
    s = F.col(size) if isinstance(size, str) else size
    return (F.when(F.coalesce(s, F.lit(0)) == 0, "file is empty")
            .when(s > max_size, f"file exceeds {max_size // 1024 // 1024} MB")
            .when(F.coalesce(n, F.lit("")) == "", "file name is missing")
            .when(~F.lower(scalars.file_extension(n)).isin(*formats), "file type is not supported"))


def format_matches(stored: str | Column, original: str | Column, uploaded: str | Column) -> Column:
    """Supplementary file test: same extension as the stored name (original name when none), any case."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    src = F.lower(scalars.file_extension(F.coalesce(F.nullif(col(stored), F.lit("")), col(original))))
    return (src == "") | (F.lower(scalars.file_extension(col(uploaded))) == src)


def tenant_write_reason(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds ``reason``: null for requests that may be written; the first request of a new code wins."""
    known = tenants.select(F.col("tenant_code"), F.lit(True).alias("__known")).distinct()
    firsts = requests.groupBy("tenant_code").agg(F.min(F.when(F.coalesce("tenant_name", F.lit("")) != "",
                                                              F.col("request_id"))).alias("__first"))
    return (requests.join(known, "tenant_code", "left").join(firsts, "tenant_code", "left")
            .withColumn("reason", F.when(F.coalesce("tenant_code", F.lit("")) == "", "tenant code is required")
                        .when(F.coalesce("tenant_name", F.lit("")) == "", "tenant name is required")
                        .when(F.col("tenant_code") == "0", "tenant 0 is reserved")
                        .when(F.col("__known") | (F.col("request_id") > F.col("__first")), "tenant code exists"))
            .select(*requests.columns, "reason"))


def assign_doc_codes(uploads: DataFrame, existing: DataFrame, day: Column, file_name: str = "file_name",
                     order: Sequence[str] = ("created_time", "id")) -> DataFrame:
    """yyyyMMdd + type letter + sequence of at least three digits, continuing from the numeric maximum."""
    df = uploads.withColumn("__prefix", F.concat(F.date_format(day, "yyyyMMdd"), scalars.type_letter(file_name)))
    suffix = F.regexp_extract("doc_code", r"^\d{8}\D(\d+)$", 1)
    top = (existing.filter(suffix != "")
           .groupBy(F.substring("doc_code", 1, 9).alias("__prefix")).agg(F.max(suffix.cast("bigint")).alias("__max")))
    df = ordered.row_numbers(df, ["__prefix"], order, "__rn")
    seq = F.coalesce(F.col("__max"), F.lit(0)) + F.col("__rn")
    text = F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string"))
    return (df.join(top, "__prefix", "left")
            .withColumn("new_doc_code", F.concat("__prefix", text)).select(*uploads.columns, "new_doc_code"))


#: Chunk numbers of a document that are aggregated in one task.
INDEX_CELL = 1 << 16


def document_summaries(chunks: DataFrame, meta: Sequence[str], tenant: str = "0", system: str | None = None) -> DataFrame:
    """Fine-chunk count per document and the metadata of its best row (fine, placeholder, any), over the chunks that the tenant may see: all for tenant '0',
    else its own of the system and those of tenant '0'."""
    if tenant != "0":
        chunks = chunks.filter(((F.col("tenant_code") == tenant) & (F.col("system_type") == system)) | (F.col("tenant_code") == "0"))
    fine = (F.col("chunk_index") >= 0) & (F.col("chunk_type") != "COARSE")
    rank = F.when(fine, 0).when(F.col("chunk_index") == -1, 1).otherwise(2)
    best = F.min_by(F.struct(*meta), F.struct(rank.alias("r"), F.col("chunk_index"), F.col("chunk_id")))
    # rows of a document meet before they are sorted for the aggregation: sorted where they are read, they would spill and seldom find each other.
    # The chunks of a very long document are dealt by ranges of their index and combined afterwards.
    cell = F.floor(F.greatest(F.coalesce("chunk_index", F.lit(0)), F.lit(0)) / INDEX_CELL)
    needed = dict.fromkeys(["document_id", "chunk_index", "chunk_type", "chunk_id", *meta])
    return (chunks.select(*needed).repartition("document_id", cell).groupBy("document_id").agg(F.sum(F.when(fine, 1).otherwise(0)).alias("chunk_count"), best.alias("m"))
            .select("document_id", "chunk_count", "m.*"))


def missing_documents(summaries: DataFrame, documents: DataFrame) -> DataFrame:
    """Metadata rows to insert for documents the table lacks, with defaults."""
    return (summaries.filter(F.col("doc_code").isNotNull())
            .join(documents.select("doc_code").distinct(), "doc_code", "left_anti")
            .select("document_id", "doc_code", F.coalesce("tenant_code", F.lit("default")).alias("tenant_code"),
                    F.coalesce("system_type", F.lit("default")).alias("system_type"), "file_name",
                    F.coalesce("title", "file_name").alias("title"), F.coalesce("file_size", F.lit(0)).alias("file_size"),
                    F.coalesce("status", F.lit("SUCCESS")).alias("status"), "chunk_count"))


def apply_transitions(documents: DataFrame, transitions: DataFrame, now: Column) -> DataFrame:
    """SUCCESS stores the count, enables and clears the error; FAILED stores the reason and disables; both set ``updated_time`` to ``now``.

    ``transitions`` has doc_code (unique), new_status, new_chunk_count, reason.
    """
    ok, bad = F.col("new_status") == "SUCCESS", F.col("new_status") == "FAILED"
    return (documents.join(transitions, "doc_code", "left")
            .withColumns({
                "chunk_count": F.when(ok, F.col("new_chunk_count")).otherwise(F.col("chunk_count")),
                "enabled": F.when(ok, F.lit(True)).when(bad, F.lit(False)).otherwise(F.col("enabled")),
                "error_message": F.when(ok, F.lit(None)).when(bad, F.col("reason")).otherwise(F.col("error_message")),
                "updated_time": F.when(ok | bad, now).otherwise(F.col("updated_time")),
                "status": F.coalesce("new_status", "status")})
            .select(*documents.columns))


def propagate_status(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk rows take status and error message of their document; a document without error clears theirs."""
    s = documents.select("doc_code", F.col("status").alias("__s"), F.col("error_message").alias("__e"))
    return (chunks.join(s, "doc_code", "left").withColumn("error_message", F.when(F.col("__s").isNull(), F.col("error_message")).otherwise(F.col("__e")))
            .withColumn("status", F.coalesce("__s", "status")).select(*chunks.columns))


def replace_rows(old: DataFrame, new: DataFrame, key: str = "doc_code") -> DataFrame:
    """Rows of replaced keys leave, the new rows enter."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def plan_reprocess(documents: DataFrame, stuck: Column, listing: DataFrame, upload_dir: str = "uploads") -> DataFrame:
    """Stuck documents marked retried, each to be rebuilt from its file or failed when the file is absent.

    ``listing`` has one row per existing file with its ``path``.
    """
    expected = F.concat(F.lit(upload_dir + "/T"), F.col("tenant_code"), F.lit("/"), F.col("stored_file_name"))
    files = listing.select(F.col("path").alias("expected_path"), F.lit(True).alias("__there")).distinct()
    return (documents.filter(stuck).withColumn("expected_path", expected).join(files, "expected_path", "left")
            .select("doc_code", "tenant_code", F.lit(1).alias("retry_count"), "expected_path",
                    F.when(F.col("__there"), "REPROCESS").otherwise("FAILED").alias("outcome")))


def exclusive_entities(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities whose mentions all come from one document, with that document."""
    docs = mentions.join(chunks.select("chunk_id", "doc_code"), "chunk_id")
    return (docs.groupBy("entity_name").agg(F.min("doc_code").alias("doc_code"), F.max("doc_code").alias("__other"))
            .filter(F.col("doc_code") == F.col("__other")).select("entity_name", "doc_code"))


def entities_only_in(dead_chunks: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities that only the chunks in ``dead_chunks`` mention: they vanish when all of these go. Mentions of unknown chunks don't count.

    Only entities that a dead chunk mentions are counted over all mentions.
    """
    lost = mentions.join(dead_chunks, "chunk_id", "left_semi").groupBy("entity_name").agg(F.count(F.lit(1)).alias("__lost"))
    of_them = mentions.join(lost.select("entity_name"), "entity_name", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    total = of_them.groupBy("entity_name").agg(F.count(F.lit(1)).alias("__n"))
    return total.join(lost, "entity_name").filter(F.col("__n") == F.col("__lost")).select("entity_name")


def clean_graph(codes: DataFrame, chunks: DataFrame, mentions: DataFrame, entities: DataFrame,
                relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks, mentions, entities and relations without the documents in ``codes``.

    What goes is found once and written; each table then loses it by anti-joins with those few ids.
    """
    gone = cut_lineage(codes.select("doc_code").distinct())
    dead_chunks = cut_lineage(chunks.join(gone, "doc_code", "left_semi").select("chunk_id"))
    dead = cut_lineage(entities_only_in(dead_chunks, mentions, chunks))
    ends = [dead.withColumnRenamed("entity_name", c) for c in ("name", "src", "dst")]
    return (chunks.join(gone, "doc_code", "left_anti"), mentions.join(dead_chunks, "chunk_id", "left_anti"), entities.join(ends[0], "name", "left_anti"),
            relations.join(ends[1], "src", "left_anti").join(ends[2], "dst", "left_anti").select(*relations.columns))


def cascade_delete(codes: DataFrame, documents: DataFrame, chunks: DataFrame, mentions: DataFrame, entities: DataFrame,
                   relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``clean_graph`` plus the metadata rows."""
    return (documents.join(codes.select("doc_code").distinct(), "doc_code", "left_anti"),
            *clean_graph(codes, chunks, mentions, entities, relations))


def messages_citing(messages: DataFrame, codes: DataFrame, key: str = "id") -> DataFrame:
    """Messages that cite any of the documents in ``codes``, each once."""
    cited = messages.select(key, F.explode(F.from_json("sources", SOURCES_SCHEMA)).alias("s")).select(key, F.col("s.docCode").alias("doc_code"))
    return messages.join(cited.join(codes.select("doc_code").distinct(), "doc_code", "left_semi").select(key).distinct(), key, "left_semi")


def mark_sources_deleted(messages: DataFrame, codes: DataFrame, key: str = "id") -> DataFrame:
    """Cited sources of deleted documents get deleted=true; other messages pass unchanged.

    The citations are exploded and matched by an equi-join, so the code list may
    be of any size; only matching codes come back to the message.
    """
    src = F.from_json("sources", SOURCES_SCHEMA)
    cited = messages.select(key, F.explode(F.array_distinct(F.transform(src, lambda s: s["docCode"]))).alias("doc_code"))
    hit = (cited.join(codes.select("doc_code").distinct(), "doc_code", "left_semi")
           .groupBy(key).agg(F.collect_set("doc_code").alias("__gone")))
    marked = F.transform(src, lambda s: s.withField("deleted", F.coalesce(s["deleted"], F.lit(False))
                                                    | F.array_contains("__gone", s["docCode"])))
    return (messages.join(hit, key, "left")
            .withColumn("sources", F.when(F.col("__gone").isNotNull(), F.to_json(marked)).otherwise(F.col("sources")))
            .select(*messages.columns))


def backfill_stored_name(documents: DataFrame) -> DataFrame:
    """code.extension where the stored name is missing; a second run changes nothing."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    todo = blank("stored_file_name") & ~blank("doc_code") & F.coalesce(F.contains("file_name", F.lit(".")), F.lit(False))
    return documents.withColumn("stored_file_name", F.when(
        todo, F.concat_ws(".", "doc_code", F.substring_index("file_name", ".", -1))).otherwise(F.col("stored_file_name")))


def fill_model(records: DataFrame, default: str) -> DataFrame:
    return records.withColumn("model", F.coalesce(F.nullif("model", F.lit("")), F.lit(default)))


def apply_key_changes(keys: DataFrame, changes: DataFrame) -> DataFrame:
    """DELETE marks the key deleted, TOGGLE flips ``enabled``. ``changes``: id (unique), action."""
    c = changes.select(F.col("id").alias("__id"), "action")
    return (keys.join(c, keys.id == F.col("__id"), "left")
            .withColumns({"is_delete": F.col("is_delete") | (F.coalesce("action", F.lit("")) == "DELETE"),
                          "enabled": F.when(F.col("action") == "TOGGLE", ~F.col("enabled")).otherwise(F.col("enabled"))})
            .select(*keys.columns))


def remote_file_rows(urls: DataFrame, url: str = "url", content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """Upload rows of remote files: the name comes from the address, the content from the table."""
    name = scalars.file_name_from_url(url)
    return urls.select(*keep, url, name.alias("file_name"), scalars.file_type(name).alias("document_type"),
                       F.length(content).cast("bigint").alias("file_size"), content)
